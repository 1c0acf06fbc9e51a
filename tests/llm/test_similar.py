"""Near copies at a similarity against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from lexweave.llm import similar
from lexweave.llm.components import union_find


def shingles(text, width=5):
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))) if own else frozenset()


def brute_groups(texts, similarity=0.8):
    """Least id of each id's group, over all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders, common = defaultdict(list), Counter()
    for k in sorted(sets):
        for s in sets[k]:
            for other in holders[s]:
                common[other, k] += 1
            holders[s].append(k)
    empty = sorted(k for k in sets if not sets[k])
    links = [p for p, n in common.items() if n >= similarity * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    roots = union_find(iter(links + [(empty[0], k) for k in empty[1:]]))
    return {k: roots.get(k, k) for k in texts}


def found(docs):
    return {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert found(docs) == brute_groups({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})


@pytest.mark.parametrize("most", [200, 4])
def test_groups_of_edited_copies(spark, monkeypatch, most):
    monkeypatch.setattr(similar, "BUCKET_MOST", most)
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 500, 300)]
    rows = {}
    for i in range(80):
        own = list(base)
        for at in rng.integers(0, 300, i % 6):
            own[at] = f"x{i}"
        rows[i] = " ".join(own)
    rows |= {100 + i: " ".join(f"w{x}" for x in rng.integers(0, 500, 300)) for i in range(60)}
    got = found(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert got == brute_groups(rows)


@pytest.mark.parametrize("block", [1000, 3])
def test_pairs_that_share_only_full_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BUCKET_MOST", 2)
    monkeypatch.setattr(similar, "BLOCK_ROWS", block, raising=False)
    rng = np.random.default_rng(2)
    base, rows = [f"w{x}" for x in rng.integers(0, 500, 300)], {}
    for i in range(0, 160, 2):
        own = list(base)
        for k, at in enumerate(rng.choice(300, 9, replace=False)):
            own[at] = f"x{i}y{k}"
            if k in (4, 8):
                rows[i + (k == 8)] = " ".join(own)
    got = found(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    want = brute_groups(rows)
    assert len(set(want.values())) > 40 and got == want


def test_odd_rows(spark):
    kind = "doc_id long, text string, sig int, node string"
    assert similar.similar_documents(spark.createDataFrame([], kind)).count() == 0
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, "a b c"), (5, "A  b\nc"), (5, "a b c"), (6, None), (7, " "), (8, "a b d"), (9, long), (None, long + " end"), (10, long + " end more")]
    got = similar.similar_documents(spark.createDataFrame([(*r, 1, "x") for r in rows], kind)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(None, 5), (5, 5), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9), (None, 9), (10, 9)])


def test_one_of_each_group_stays_whatever_its_id(spark):
    import corpus_pipeline

    kind = "doc_id long, text string, n_chars long"
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, "alone without an id"), (None, "Alone  without an id"), (None, "a second one of these"), (7, "one text"), (7, "quite another text"), (7, "Quite another text"), (8, long), (None, long + " end"), (9, "A b c"), (10, "a b c"), (11, None)]
    kept = lambda r: Counter(x["text"] for x in corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame([(*x, 1) for x in r], kind), "").collect())
    assert kept(rows) == Counter(["Alone  without an id", "a second one of these", "one text", "Quite another text", long, "A b c", None])
    assert kept([(None, t) for _, t in rows]) == Counter(["Alone  without an id", "a second one of these", "one text", "Quite another text", kept([(None, long), (None, long + " end")]).popitem()[0], "A b c", None])
    assert kept([r for r in rows if r[0] in (8, 9, 10)]) == Counter([long, "A b c"])


def test_every_link_is_checked(spark, monkeypatch):
    """Values that agree by chance link nothing: whole texts decide."""
    monkeypatch.setattr(similar, "min_hashes", lambda hashes: np.zeros(similar.VALUES, dtype="<u2"))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"x{i}_{j}" for j in range(30)])) for i in range(6)] + [(10, " ".join(words)), (11, " ".join(words + ["end"]))]
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: i for i in range(6)}, 10: 10, 11: 10}
