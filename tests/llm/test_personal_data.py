"""Personal data: the patterns against their plain form, the field against all labellings, the query against both."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lexweave.llm import personal_data as P
from lexweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0, 10 <= len(digits) <= 15][kind]
            if keep:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["0123456789 -.", "a@.b-+ 1", "+0123 ().-", "0014. -@+é\n"])
def test_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert P.base_spans(text) == plain(text), text
    for text in ("4785380592391139 4785-3805 9239-1139", "a@b.c.d@e.f", "x@@a.b", "300.1.1.1.1.1.1", "0000255.1.1.1", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8", "a" * 3000 + "@b.c", "0" * 5000 + ".1.1.1"):
        assert P.base_spans(text) == plain(text) if len(text) < 5000 else P.base_spans(text)


def test_long_runs_stay_linear():
    """Megabytes of digits, dots, signs or letters without a blank."""
    for text in ("1" * 2_000_000, "a" * 2_000_000, "1." * 1_000_000, "+1 " * 500_000, "a@" * 500_000, "12 " * 100_000):
        P.base_spans(text)
    assert len(P.tokens_of("a" * 1_000_000 + "1" * 1_000_000)) == 1
    assert len(P.graph_of("12 " * 20_000).spans) == 20_000


def test_marginals_are_exact_without_loops():
    """On a tree the messages give what adding up all labellings gives."""
    rng = np.random.default_rng(5)
    k = len(P.KINDS) + 1
    field = P.Field(rng.normal(size=(P.N_FEATURES, k)), rng.normal(size=(2, k, k)))
    links = np.array([(0, 1, 0), (1, 2, 0), (0, 3, 1), (3, 4, 0)])
    graphs = [P.Graph(np.zeros((5, 2), np.int64), rng.integers(0, 2, (5, P.N_FEATURES)).astype(np.uint8), links), P.Graph(np.zeros((1, 2), np.int64), np.ones((1, P.N_FEATURES), np.uint8), np.zeros((0, 3), np.int64))]
    P_ROUNDS = 40
    rounds, P.ROUNDS = P.ROUNDS, P_ROUNDS
    try:
        got = field.marginals(graphs)
    finally:
        P.ROUNDS = rounds
    for g, p in zip(graphs, got, strict=True):
        u, total = g.features @ field.weights, np.zeros(p.shape)
        for labels in itertools.product(range(k), repeat=len(u)):
            w = np.exp(sum(u[i, y] for i, y in enumerate(labels)) + sum(field.pairs[t, labels[a], labels[b]] for a, b, t in g.links))
            total[np.arange(len(u)), labels] += w
        assert np.allclose(p, total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_distant_copies_agree():
    """A token whose own look leaves it open takes the label of its like far away, by the skip link alone."""
    g = P.graph_of("mail best.54@mail3.example.com " + "word " * 400 + "user best.54 left " + "word " * 99 + "best.54@mail3.example.com")
    assert {tuple(e) for e in g.links.tolist()} == {(0, 1, 1), (1, 2, 1), (0, 2, 1)}
    k = len(P.KINDS) + 1
    field = P.Field(np.zeros((P.N_FEATURES, k)), np.stack([np.zeros((k, k)), 4 * np.eye(k)]))
    field.weights[:, 0] = -0.01
    at = 1 + (len(P._DIGITS) + 1) * 2 + (len(P._FEW) + 1) * 3
    field.weights[at, 1] = 6.0  # an at sign
    sure = field.marginals([g])[0]
    assert (sure.argmax(axis=1) == 1).all() and sure[1, 1] > 0.9
    alone = field.marginals([P.graph_of("user best.54 left")])[0]
    assert alone[0, 1] < 0.5


def test_query(spark):
    """Counts and digest by the plain patterns; all their spans stay; what is added touches none of them."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    show = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(show(want).encode()).hexdigest()
        every = [(int(a), P.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in filter(None, r["spans"].split(",")))]
        assert every == sorted(every) and set(want) <= set(every)
        assert all(b <= x or a >= y for a, k, b in set(every) - set(want) for x, _, y in want)


def test_other_ways_of_writing(spark):
    """A field fitted on plain finds and ordinary numbers finds values written otherwise; clean texts stay clean."""
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(200):
        card = number(15)
        card += next(c for c in "0123456789" if P.luhn(card + c))
        parts = [f"in {rng.randrange(1900, 2030)}", f"some {rng.randrange(90)} people", f"no. {i}", f"{number(5)} in all", f"v{i}.2", f"user{i}@host{i % 7}.example.com", f"+1 ({number(3)}) 555-{number(4)}", ".".join(str(rng.randrange(256)) for _ in range(4)), card]
        rng.shuffle(parts)
        texts.append(" and so ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = P.fit_field(docs)
    odd = [(1, "call (743) 555-3824 or 743.555.9999 soon"), (2, "write hein.19(at)mail5.example(dot)com please"), (3, "in 1999 some 40 people met"), (4, None), (5, ""), (5, "no. 7"), (None, "host 10[.]20[.]30[.]40 is up")]
    df = spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, spans string, n_ip int")
    got = sorted(((r["doc_id"], r["spans"], r["redacted"]) for r in P.find_personal_data(df, field).collect()), key=repr)
    assert got == sorted([(1, "phone:5:19,phone:23:35", "call [PHONE] or [PHONE] soon"), (2, "email:6:38", "write [EMAIL] please"), (3, "", "in 1999 some 40 people met"), (4, "", ""), (5, "", ""), (5, "", "no. 7"), (None, "ip:5:22", "host [IP] is up")], key=repr)
    assert P.fit_field(spark.createDataFrame([], "doc_id long, text string")) is None
    assert P.fit_field(spark.createDataFrame([(1, "no. 7")], "doc_id long, text string")) is None
    none = P.find_personal_data(df.limit(0), None)
    assert none.count() == 0 and "spans" in none.columns
    carried = P.find_personal_data(df, None, carry=True).select("row.*")
    assert carried.columns == df.columns and carried.count() == len(odd)
