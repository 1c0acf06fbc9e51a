"""Operators against brute force on small tables, and their odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexweave.llm import langid, neighbours, packing, quality, repeats, secrets, sharding, simhash
from lexweave.llm.decontaminate import find_contamination
from lexweave.llm.elias_fano import EliasFano
from lexweave.llm.hilbert import hilbert_keys
from lexweave.llm.queries import QUERIES, TOKENIZER
from lexweave.llm.run_index import RunIndex
from lexweave.llm.token_files import TokenFile, pack_file, read_token_files, write_token_files

SF = "/root/testdata/sf0.001"
ODD = [(None, None, None), (1, None, "en"), (2, "", "en"), (3, " \n", None), (4, "Ünï çödé ſ İ ", "de"), (4, "Ünï çödé ſ İ ", "de"), (5, "the same words again " * 3000, "en"), (6, "the same words again " * 3000, "en"), (7, "12 34 !?", "fr"), (8, "a", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "src", 0, 1.5) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(TOKENIZER)
    return {k: tok.encode(t, add_special_tokens=False).ids for k, t in texts.items()}


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_packing(spark, ids):
    rows = QUERIES["op1_packing"](spark, SF).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        whole, at = [*ids[k], 1], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == crc(whole[at : at + r["length"]])
            at += r["length"]
        assert at == len(whole)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    groups = defaultdict(lambda: defaultdict(int))
    for r in rows:
        groups[r["tier"], r["step_group"]][r["sequence_id"]] += r["length"] ** 2
    assert all(len(g) * t <= packing.STEP_IDS for (t, _), g in groups.items())


def test_pack_fills_every_tier():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 200):
        lengths = rng.integers(1, 5000, n).tolist()
        out, rest = packing.pack(lengths)
        assert all(s.used == s.tier for s in out)
        assert sum(p[2] for p in rest) < min(packing.TIERS)
        seen = defaultdict(list)
        for d, s, k in [p for q in out for p in q.pieces] + rest:
            seen[d].append((s, k))
        for d, length in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[d]):
                assert s == at
                at += k
            assert at == length


def brute_groups(items):
    root = {k: k for k in items}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(items)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(items[a] ^ items[b]).count("1") <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def plain_print(text, width=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))] if own else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op2_simhash"](spark, SF).collect()}
    prints = {k: plain_print(t) for k, t in texts.items()}
    assert {k: r["fingerprint"] for k, r in rows.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: r["component_id"] for k, r in rows.items()} == brute_groups(prints)


@pytest.mark.parametrize("most", [48, 3])
def test_simhash_links_dense_groups(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "KEY_MOST", most)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(60)}
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 40)} | {0, 15, 255}
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    found = {(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    near = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert found <= near
    if most == 48:
        assert near == found or len(prints) > most
    groups = brute_groups({x: x & (2**64 - 1) for x in signed})
    from lexweave.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(list(found) or [(0, 0)], "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in signed} == groups


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[0].tolist()) for i in range(30)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (404, [1.0]), (None, x[1].tolist()), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for q, own in got.items():
        v = dict(good)[q]
        want = sorted(((-float(v @ w), i) for i, w in good if i != q))[:20]
        assert np.allclose([s for _, s in own], [-s for s, _ in want])
        assert len({i for i, _ in own} & {i for _, i in want}) >= 19
    assert neighbours.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [0.1, 1.0])
def test_neighbours_at_near_ties(spark, monkeypatch, scale):
    """Permuted components give products that differ by rounding alone; ranks follow the sum from the first component to the last."""
    for name, value in {"BLOCK": 64, "REACH": 64, "QUERY_BLOCK": 16}.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.permutation(np.arange(1, 9) if i % 3 else [0, 0, 0, 0, 1, 1, 1, -3]) * scale).tolist()) for i in range(700)]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    def exact(v, w):
        total = 0.0
        for a, b in zip(v, w, strict=True):  # sum() would make up for rounding
            total += a * b
        return total

    for q, own in got.items():
        want = sorted((-exact(rows[q][1], w), i) for i, w in rows if i != q)[:20]
        assert own == [(i, -s) for s, i in want]


def test_hilbert_steps_are_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute_repeats(texts, w=400):
    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + w] for r in raw for i in range(len(r) - w + 1))
    out = []
    for r in raw:
        hit = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                hit[i : i + w] = b"\1" * w
        kept = bytes(b for b, h in zip(r, hit, strict=True) if not h)
        out.append((len(r), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1500, 3])
def test_repeats(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_MOST", most)
    names = sorted(texts)
    want = dict(zip(names, brute_repeats([texts[k] for k in names]), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == want


def test_repeats_passage_in_many(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_MOST", 5)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage = word(520)
    texts = [word(300 + 7 * i) + passage + word(200 + 5 * i) for i in range(12)] + [passage[:450] + passage[:450], word(399), "x" * 2000]
    got = [tuple(r)[1:] for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()]
    assert got == brute_repeats(texts)


def test_matching_statistics():
    rng = np.random.default_rng(5)
    for letters in (b"ab", b"abcd"):
        for _ in range(30):
            word = lambda x, most=40: bytes(rng.choice(list(x), rng.integers(1, most)).astype(np.uint8))  # noqa: B023, E731
            strings = [word(letters) for _ in range(rng.integers(1, 8))]
            strings += [strings[0][2:]] if len(strings[0]) > 3 else []
            patterns = [word(letters + b"z") for _ in range(4)] + strings[:2] + [b""]
            index = RunIndex(strings, stream=True)
            for p, (length, place) in zip(patterns, index.matching_statistics(patterns), strict=True):
                for i in range(len(p)):
                    n = max(n for n in range(len(p) - i + 1) if any(p[i : i + n] in x for x in strings))
                    assert n == length[i] and index.data[place[i] : place[i] + n].tobytes() == p[i : i + n]


def test_repeats_streamed_through_an_index(spark, monkeypatch):
    for name, value in {"GROUP_MOST": 3, "INDEXED": 4, "STREAMED": 6, "SALTS": 3}.items():
        monkeypatch.setattr(repeats, name, value)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, other = word(520), word(430)
    texts = [word(50 + 7 * i) + passage[i % 9 : 500 + i % 17] + word(20 + 5 * i) for i in range(30)] + [passage + other, other[3:] + passage, other + other, word(3000)]
    texts += [t + "!" for t in texts[:5]] + texts[:3]
    got = [tuple(r)[1:] for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()]
    assert got == brute_repeats(texts)


def test_run_index_counts_down():
    rng = np.random.default_rng(4)
    for letters in (b"ab", b"abcd"):
        for _ in range(40):
            own = [bytes(rng.choice(list(letters), rng.integers(1, 60))) for _ in range(rng.integers(1, 7))]
            own += own[: rng.integers(0, 2)]
            index = RunIndex(own)
            at, n = index.long_matches(5)
            string, offset = index.where(at)
            got = [set() for _ in own]
            for s, o, k in zip(string, offset, n, strict=True):
                got[s].update(range(o, o + k))
            seen = Counter(x[i : i + 5] for x in own for i in range(len(x) - 4))
            assert got == [{j for i in range(len(x) - 4) if seen[x[i : i + 5]] > 1 for j in range(i, i + 5)} for x in own]


def test_language_scores_by_hand(spark, docs):
    model = langid.fit_language_model(docs)
    for text in ("The same WORDS, again 12!", "é", "öfter " * 9):
        raw = b" " + b" ".join(re.sub(rb"[^A-Za-z\x80-\xff]", b" ", text.lower().encode()).split()) + b" "
        rows = [(k << langid.BUCKET_BITS) + (int.from_bytes(raw[i : i + n], "big") * 2654435761 % 2**32 >> 32 - langid.BUCKET_BITS) for k, n in enumerate(langid.ORDERS) for i in range(len(raw) - n + 1)]
        z = (sum(model.table[r] for r in rows) / len(rows) + model.bias) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        assert model.predict(text) == (model.languages[int(p.argmax())], pytest.approx(p.max()))


def test_language_held_out_accuracy(spark, docs):
    rows = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.97
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.02


def test_decontaminate(spark, docs, texts):
    item = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {k: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} for k, t in item.items() if (w := split(t))}
    got = {r["doc_id"]: r for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    for k, t in texts.items():
        w, hit, items = split(t), set(), set()
        for name, own in wins.items():
            for win in own:
                for i in range(len(w) - len(win) + 1):
                    if w[i] == win[0] and tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        items.add(name)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


@pytest.mark.parametrize(("pack", "share", "chunk"), [(8, 1 << 20, 1 << 20), (8, 1 << 20, 60), (1, 30, 1 << 20)])
def test_decontaminate_with_many_automata(spark, monkeypatch, pack, share, chunk):
    from lexweave.llm import decontaminate

    rng = np.random.default_rng(3)
    items = [(i, " ".join(rng.choice(list("abcde"), rng.integers(0, 14)))) for i in range(12)] + [(3, "a a a a"), (None, "b b"), (13, None)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdef"), rng.integers(0, 60)))) for i in range(40)] + [(None, None), (99, "")], "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, find_contamination(docs, bench, size=4).collect()), key=repr)
    for name, value in {"PACK_WORDS": pack, "SHARE_BYTES": share, "CHUNK_BYTES": chunk}.items():
        monkeypatch.setattr(decontaminate, name, value)
    assert sorted((tuple(r)[:-1] for r in find_contamination(docs, bench, size=4, carry=True).collect()), key=repr) == want
    hits = {r["doc_id"]: set(r["items"]) for r in find_contamination(docs, bench, size=4).collect()}
    for r in docs.where("doc_id is not null and text <> ''").collect():
        own = f" {r['text']} "
        wins = {str(k) if k is not None else "": [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] for k, t in items if k != 3 and (w := (t or "").split())}
        wins["3"] = [" ".join(w[i : i + 4]) for k, t in items if k == 3 for w in [t.split()] for i in range(max(1, len(w) - 3)) if w]
        assert hits[r["doc_id"]] == {k for k, x in wins.items() if any(f" {w} " in own for w in x)}


def test_decontaminate_spans(spark):
    docs = spark.createDataFrame([(1, "Hé! One, two THREE é four."), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three"), (8, None), (9, "?!")], "item_id long, text string")
    r = find_contamination(docs, bench, carry=True).orderBy("doc_id").collect()
    assert r[0]["items"] == ["7"] and [tuple(s) for s in r[0]["spans"]] == [(4, 18)] and r[0]["row"]["text"].startswith("Hé")
    assert (r[1]["n_words"], r[1]["contaminated"]) == (0, False)


def kneser_ney_by_hand(texts, order=5):
    """P(symbol | context of up to order - 1 bytes) of an interpolated modified Kneser-Ney model, from dictionaries."""
    tables = {order: Counter()}
    for t in texts:
        raw = bytes(order - 1) + t.encode() + b"\0"
        tables[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    steps = {}
    for k, t in tables.items():
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else i / 2 for i in (1, 2, 3)]
        steps[k] = [max(0.05, min(0.95 * i, d)) for i, d in enumerate(raw, 1)]
    sums = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g, n in t.items():
            sums[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        ns, low = sums[k].get(g[:-1]), p(g[1:])
        if not ns:
            return low
        off = lambda n: steps[k][min(n, 3) - 1]
        n = tables[k].get(g, 0)
        return ((n - off(n)) if n else 0) / sum(ns) + sum(map(off, ns)) / sum(ns) * low

    return p


def test_perplexity_matches_a_model_by_hand(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK_BYTES", 100)
    train = [(1, "the cat sat on the mat. " * 5 + "a dog", "en"), (2, "der Hund und die Katze, öfter müde", "de"), (3, None, "en"), (4, "the rat sat", "en"), (5, "没有 кот", "xx")]
    docs = spark.createDataFrame([*train, (7, "the cat ate the mat", "en"), (8, "müde Katze", "de"), (9, "没 кот the", None), (10, "", "en"), (11, "the dog", "zz")], "doc_id long, text string, lang string").repartition(2)
    grams = quality.count_grams(spark.createDataFrame(train, docs.schema))
    pooled = F.col("key").bitwiseAND(F.lit((1 << 40) - 1)).bitwiseOR(F.lit(quality.lang_key("*")))
    pool = grams.groupBy(pooled.alias("key")).agg(F.sum("n").alias("n"))
    langs = {"en", "de", "xx"}
    got = {r["doc_id"]: r for r in quality.perplexities(docs, quality.kneser_ney(grams.unionByName(pool)), langs).collect()}
    by_hand = {x: kneser_ney_by_hand([t for _, t, lang in train if t is not None and x in (lang, "*")]) for x in (*langs, "*")}
    for r in docs.collect():
        raw = bytes(4) + (r["text"] or "").encode() + b"\0"
        p = by_hand[r["lang"] if r["lang"] in langs else "*"]
        want = np.exp(-np.mean([np.log(p(raw[i : i + 5])) for i in range(len(raw) - 4)])) if r["text"] else None
        assert got[r["doc_id"]]["perplexity"] == (pytest.approx(want, rel=1e-5) if want else None)
    p = by_hand["en"]
    for context in (b"the ", b"q", b""):
        assert sum(p(context + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_trusted_documents_are_those_of_the_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILTER_BITS", 64)
    docs = spark.createDataFrame([(i, f"text ü {i} " if i % 7 else None, "en") for i in range(200)] + [(3, "again", "de"), (None, "x", "en")], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(3,), (3,), (7,), (199,), (500,), (None,)], "doc_id long")
    assert Counter(r["text"] for r in quality.trusted_documents(docs, ids).collect()) == Counter(["text ü 3 ", "again", "text ü 199 "])


def test_quality_finds_noise(spark):
    rows = QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    kept = lambda q: np.mean([r["keep"] for r in rows if r["quality"] == q])
    assert kept(1) > 0.95 and kept(0) < 0.1


def test_quality_by_language(spark):
    """One rule at every size: with more data each language keeps good documents and few bad ones."""
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("lang", "quality").agg(F.avg(F.col("keep").cast("double")).alias("k"), F.count("*").alias("n")).collect()
    assert {r["lang"] for r in rows} == {"de", "en", "es", "fr"}
    for r in rows:
        assert r["k"] >= 0.95 if r["quality"] == 1 else r["k"] <= 0.1, r


def test_thresholds_by_hand(spark):
    """A language's own tail and the tail of all, by the number of its documents; one bad document of a few opens no gate."""
    rng = np.random.default_rng(2)
    groups = {"many": np.exp(rng.normal(1.0, 0.1, 4000)), "some": np.exp(rng.normal(2.0, 0.2, 200)), "few": np.exp([1.5, 1.5, 1.5, 1.5, 9.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("none", None)], "lang string, perplexity double")
    got = {r["cut_lang"]: (r["low"], r["high"]) for r in quality.thresholds(df, 0.01, 0.95).collect()}
    logs = {k: np.log(v) for k, v in groups.items()}
    middle = {k: np.quantile(v, 0.5, method="inverted_cdf") for k, v in logs.items()}
    shared = np.quantile(np.concatenate([v - middle[k] for k, v in logs.items()]), [0.01, 0.95], method="inverted_cdf")
    assert set(got) == set(groups)
    for k, v in logs.items():
        own = np.quantile(v - middle[k], [0.01, 0.95], method="inverted_cdf")
        w = len(v) / (len(v) + quality.HELD_EVEN)
        assert np.allclose(np.log(got[k]), middle[k] + w * own + (1 - w) * shared, atol=0.02)
    assert np.log(got["few"][1]) < 2.0


def test_special_tokens_are_the_librarys(spark):
    """Texts that name an added token, in any case of letters, give the library's ids, in sequences and in files."""
    texts = [(1, "hello <|endoftext|> world"), (2, "<|startoftext|>a<|endoftext|>"), (3, "A <|ENDOFTEXT|> b"), (4, "plain <| endoftext |> words"), (5, "<|endoftext|>" * 300), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tok = Tokenizer.from_file(TOKENIZER)
    want = {k: tok.encode(t or "", add_special_tokens=False).ids for k, t in texts}
    assert want[1] == [3306, 49407, 1002]
    read = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in read_token_files(write_token_files(docs, TOKENIZER)).collect()}
    assert read == {k: (len(v) + 1, crc([*v, 2])) for k, v in want.items()}
    pieces = defaultdict(list)
    for r in packing.pack_documents(docs, TOKENIZER, with_ids=False).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for k, own in pieces.items():
        whole = [*want[k], 1]
        assert [x[2] for x in sorted(own)] == [crc(whole[a : a + n]) for a, n, _ in sorted(own)] and sum(n for _, n, _ in own) == len(whole)


def test_items_of_any_number_of_words():
    """An item with more different words than there are characters comes in pieces that have all its windows once."""
    from lexweave.llm import decontaminate

    item = " ".join(f"w{i}" for i in range(1_150_000))
    pieces = list(decontaminate._pieces(item, 10))
    own, starts = decontaminate.words(item), []
    for p in pieces:
        w = decontaminate.words(p)
        at = int(w[0][1:])
        assert own[at : at + len(w)] == w and len(w) <= decontaminate.PACK_WORDS + 9
        starts += range(at, at + len(w) - 9)
    assert starts == list(range(len(own) - 9))
    assert decontaminate.WordAutomaton([("x", pieces[-1])]).automaton is not None


def test_sharding(spark, docs, texts):
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shards = defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(40))
    rng = np.random.default_rng(0)
    sizes = np.stack([rng.integers(1, 9000, 5000), rng.integers(1, 900, 5000), np.ones(5000, int)], axis=1)
    loads = np.zeros(40)
    for r in rows:
        loads[r["shard"]] += r["size"]
    at = sharding.place(sizes, 40)
    for c in range(3):
        sums = np.bincount(at, sizes[:, c], 40)
        assert sums.max() / sums.mean() < 1.02


def test_sharding_law_and_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 700)
    rng = np.random.default_rng(1)
    texts = [f"{i} " + "x" * int(n) for i, n in enumerate(rng.integers(0, 900, 3000))]
    texts += ["copy a" * 100] * 25 + ["copy b" * 40] * 30 + ["hot" * 200] * 700 + [""] * 50 + [None] * 50
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 10).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    sizes, groups, slots = np.zeros(10), defaultdict(set), defaultdict(list)
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16
        sizes[r["shard"]] += r["size"]
        groups[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert sizes.max() / sizes.mean() < 1.02 and sizes.min() / sizes.mean() > 0.98
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    part = sizes.mean()
    assert {t for t, x in groups.items() if len(x) > 1} == {t for t in groups if t and texts.count(t) * (len(t) + 16) > part}


def test_sharding_balances_all_three(spark, monkeypatch):
    """Texts with many words a byte and thousands of short copies: bytes, tokens and rows are shared out together, and no task gets all copies."""
    monkeypatch.setattr(sharding, "TASK_ROWS", 1000)
    rng = np.random.default_rng(4)
    texts = [" ".join(["w" * (1 if i % 20 == 0 else 6)] * int(n)) for i, n in enumerate(rng.integers(20, 400, 4000))] + [""] * 3000 + [None] * 10
    out = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 8)
    rows = out.groupBy("shard").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    ratio = {c: max(r[c] for r in rows) / np.mean([r[c] for r in rows]) for c in "btn"}
    assert len(rows) == 8 and ratio["b"] < 1.02 and ratio["t"] < 1.05
    # The empty texts are one group, which one shard's bytes can hold, so its rows stay together there.
    assert {r["shard"] for r in out.where("size = 16 and text_crc32 = 0").select("shard").distinct().collect()}.__len__() <= 2


def test_token_files(spark, ids):
    rows = {r["doc_id"]: r for r in QUERIES["op9_token_files"](spark, SF).collect()}
    at = 0
    for k in sorted(ids):
        whole = [*ids[k], 2]
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"]) == (at, len(whole), crc(whole))
        at += len(whole)
    names = [None, None, -5, 3, 3, 1 << 62]
    file = TokenFile(pack_file(names, [np.array([1, 70000], np.uint32), np.array([], np.uint32), *[np.array([i], np.uint32) for i in range(4)]]))
    assert file.doc_ids == names and file.ids(0).tolist() == [1, 70000] and file.ids(1).tolist() == [] and file.ids(5).tolist() == [3]
    assert TokenFile(pack_file([], [])).doc_ids == [] and TokenFile(pack_file([None], [np.array([2], np.uint32)])).doc_ids == [None]
    many = [np.array([7], np.uint32)] * 1000
    assert len(pack_file(list(range(10**9, 10**9 + 1000)), many)) < 1000 * (2 + 2)  # ids of 2 bytes, and little more
    with pytest.raises(ValueError):
        pack_file([5, 4], many[:2])


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (1000, 5), (1000, 10**9), (700, 700)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        ef, used = EliasFano.from_bytes(EliasFano.encode(v).to_bytes() + b"rest")
        assert ef.values().tolist() == v.tolist() == [ef.select(i) for i in range(n)]
    assert len(EliasFano.encode(np.arange(10_000, dtype=np.uint64) * 1000).to_bytes()) < 10_000 * 13 / 8


def test_secrets(spark, docs, texts):
    pats = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    fits = [lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24]
    got = {r["doc_id"]: r for r in QUERIES["op10_secrets"](spark, SF).collect()}
    for k, t in texts.items():
        spans = sorted((m.start(), n, m.end()) for n, p in enumerate(pats) for m in p.finditer(t) if fits[n](m))
        line = ",".join(f"{('assign', 'access', 'hex')[n]}:{a}:{b}" for a, n, b in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[k][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(n == i for _, n, _ in spans) for i in range(3)]


def test_guess_cost():
    cost = lambda v: secrets.guess_cost(v)[0]
    assert cost("password") < 2 and cost("P@ssw0rd") < 3 and cost("qwertyuiop") < 4 and cost("aaaaaaaaaa") < 4 and cost("1999-12-31") < 6
    assert cost("x7Kq9pLw2Vz4") > 10
    assert secrets.guess_cost("password1999")[1] == [("word", 0, 8), ("date", 8, 12)]
    base, added = secrets.find_secrets("pwd = 'x7Kq9!pLw2Vz4' and token: token:secretvalue")
    assert [k for _, k, _, _ in added] == [3] and base == []
    assert secrets.find_secrets("pwd: password, auth: qwerty")[1] == []


def brute_cost(value, ranks):
    """The least cost over all splits into parts, each judged by itself."""
    lines = [x for row in secrets.ROWS + ("abcdefghijklmnopqrstuvwxyz",) for x in (row, row[::-1])]

    def parts(a, b):
        v, low = value[a:b], value[a:b].lower()
        out = [("brute", 1.0 if v.isdigit() else np.log10(26) if v.isalpha() else 1.5)] if len(v) == 1 else []
        cased = 0.0 if v.islower() else 0.5
        soft = low.translate(secrets.LEET)
        if soft.isalpha() and len(v) <= secrets.WORD_MOST:
            out += [("word", np.log10(ranks[x] + 1) + more + cased) for x, more in ((low, 0.0), (soft, 0.5)) if x in ranks]
        m = secrets.DATE.match(value, a)
        if m and m.end() == b:
            out.append(("date", 2.1 if b - a == 4 else 4.6))
        if len(v) >= 3 and any(low in x for x in lines) and not (b < len(value) and any(value[a : b + 1].lower() in x for x in lines)):
            out.append(("walk", 1.7 + np.log10(len(v))))
        for block in range(1, 9):
            times = len(v) // block
            longer = value[a : b + block] == v[:block] * (times + 1)
            if times >= 2 and len(v) == times * block >= 3 and v == v[:block] * times and not longer:
                out.append(("repeat", block * 1.4 + np.log10(times)))
        return out

    best = {(0, "brute"): 0.0}
    for b in range(1, len(value) + 1):
        for kind in ("brute", "other"):
            found = [best[a, last] + cost + (0.0 if a == 0 or last == name == "brute" else 0.3) for a in range(b) for name, cost in parts(a, b) if (name == "brute") == (kind == "brute") for last in ("brute", "other") if (a, last) in best]
            if found:
                best[b, kind] = min(found)
    return min(v for (b, _), v in best.items() if b == len(value))


def test_guess_cost_matches_all_splits():
    rng = np.random.default_rng(7)
    ranks = {"pass": 3, "word": 9, "password": 1, "so": 40, "dog": 700, "as": 20}
    bits = ["pass", "Word", "p4ss", "so", "dog", "1999", "12.3.2001", "abab", "aaaa", "qwer", "fdsa", "xyz", "Q", "7", "!", "é", "ẞ", "$0"]
    for _ in range(400):
        value = "".join(rng.choice(bits, rng.integers(1, 5)))
        cost, parts = secrets.guess_cost(value, ranks)
        assert cost == pytest.approx(brute_cost(value, ranks)), value
        assert [a for _, a, _ in parts] == [0, *(b for _, _, b in parts[:-1])] and parts[-1][2] == len(value)


def test_dictionary_has_a_size(spark, monkeypatch):
    monkeypatch.setattr(secrets, "WORDS_MOST", 3)
    monkeypatch.setattr(secrets, "RANKS", {})
    docs = spark.createDataFrame([(1, "aa aa aa bb bb bb cc cc dd pwd: aabbccddxyz"), (2, None)], "doc_id long, text string")
    assert secrets.word_ranks(docs) == {"aa": 2, "bb": 2, "cc": 3}


def redacted(spark, text):
    return secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["redacted"]


def test_guess_cost_sees_whole_values_of_all_names(spark):
    for name in ("password", "passwd", "secret", "token", "api_key", "pwd"):
        for value in ("X!9k#Lm2$qP", "Tr0ub4dor&3xY#", "k;9Q,z|7<Wp!m"):
            for text in (f'{name}: "{value}" end', f"{name}={value} end", f"{name} = '{value}'; end"):
                assert redacted(spark, text) == text.replace(value, "[SECRET]"), text
    assert redacted(spark, "auth: bearer: x7Kq9!pLw2Vz4, user: bob") == "auth: bearer: [SECRET], user: bob"
    base, added = secrets.find_secrets("password: Tr0ub4dor&3xY#")
    assert base == [(0, 0, 19, 10)] and added == [(10, 3, 24, 10)]


def test_secrets_of_any_length(spark):
    import time

    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"))
    for n in (127, 128, 129, 700, 5000):
        key = "".join(rng.choice(letters, n))
        for name in ("private_key=", "bearer: ", "access_key: ", 'credentials: "', "token="):
            assert redacted(spark, f"a {name}{key}\nb") == f"a {name}[SECRET]\nb", (name, n)
    assert secrets.find_secrets("pass: " + "*" * 5000)[1] == [] and secrets.find_secrets("pass: " + "ab1-" * 5000)[1] == []
    start = time.process_time()
    assert secrets.find_secrets("pass:" * 20_000 + "x" * 50_000 + "".join(rng.choice(letters, 20_000)))[1]
    assert time.process_time() - start < 60


def test_words_of_the_corpus_are_no_secrets(spark):
    prose = ["Credentials: Bachelor", "pass: Thursday", "Compass: Northwest", "PIN: Geburtstagsfeier", "pass: Gouvernement,", "credentials: Universidad"]
    other = "a bachelor on thursday flew northwest to the geburtstagsfeier of the gouvernement and the universidad"
    rows = [*enumerate([*prose, "my credentials: Xqvzjwkhtrbn", "Compass: Wqzjxkvbtrnm", "dbPass: Zkvqxwrtplmnhg DB_PASS=Zkvqxwrtplmnhg"]), (20, other)]
    got = {r["doc_id"]: r["redacted"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == prose and got[20] == other
    assert got[6] == "my credentials: [SECRET]" and got[7] == "Compass: Wqzjxkvbtrnm" and got[8] == "dbPass: [SECRET] DB_PASS=[SECRET]"


def test_secrets_of_one_class_of_letters(spark):
    for text in ("pwd=zkvqxwrtplmnhg", "passphrase: vexolquamridonfleck", "pin: 8394761502874613", "auth: ZKVQXWRTPLMNHG"):
        name, value = re.split("(?<=[=:]) ?", text)
        assert redacted(spark, text) == text.replace(value, "[SECRET]")
    assert redacted(spark, "pin: 1234567890, pass: welcome, pwd: aaaaaaaaaaaa") == "pin: 1234567890, pass: welcome, pwd: aaaaaaaaaaaa"


def test_odd_rows(spark, odd):
    """Nulls, blanks, odd letters, repeated rows, an extra column named like an inner one, and no rows at all."""
    bench = spark.createDataFrame([(1, None), (2, "same words again the same words")], "item_id long, text string")
    runs = {
        "pack": lambda d: packing.pack_documents(d, TOKENIZER),
        "simhash": simhash.near_duplicates,
        "repeats": repeats.remove_repeats,
        "language": lambda d: langid.predict_language(d, langid.fit_language_model(d), carry=True),
        "bench": lambda d: find_contamination(d, bench, carry=True),
        "quality": lambda d: quality.score_quality(d, d.select("doc_id")),
        "shards": lambda d: sharding.shard_documents(d, 4),
        "files": lambda d: read_token_files(write_token_files(d, TOKENIZER)),
        "secrets": lambda d: secrets.scan_secrets(d, carry=True),
    }
    for name, f in runs.items():
        n = len({(r["doc_id"], r["start"], r["sequence_id"]) for r in f(odd).collect()}) if name == "pack" else f(odd).count()
        assert n >= len(ODD), name
        assert f(odd.limit(0)).count() == 0, name
    got = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert got[1]["fingerprint"] == "0" * 16 and got[1]["component_id"] == 1 == got[3]["component_id"] and got[6]["component_id"] == 5
    lang = {r["doc_id"]: r for r in runs["language"](odd).collect()}
    assert lang[1]["lang_pred"] == lang[7]["lang_pred"] == "und" and lang[7]["score"] == 0
    rep = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(odd).collect()}
    assert rep[5] == rep[6] == len(ODD[6][1]) and rep[4] == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.drop("fp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "no such text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 5 in out and 6 not in out and 1 not in out
