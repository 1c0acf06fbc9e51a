"""Near copies by SimHash and MinHash candidates with an exact check of shingle sets (operator 2 in the pipeline).

SimHash bits within a small budget find near copies that share nearly all shingles, yet at a similarity of
0.8 a bit differs with a chance of 0.15, beyond any budget that leaves selective segments. Bands
of MinHash values find those; every link of either kind is then held against the similarity itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, steps, texts_of, written
from .components import connected_components
from .simhash import SEED, bits_of, majority, near_links, shingle_hashes

#: Two at 0.8 share none of 20 bands of 5 values with a chance of 0.0004.
BANDS, ROWS = 20, 5
VALUES = BANDS * ROWS
#: Buckets of up to so many are compared pair by pair; members of fuller ones with the bucket's leaders, then by their rarest shingles.
BUCKET_MOST = 16
#: Leaders of a fuller bucket.
LEADERS = 3
#: Nodes, and shingles of all their sets, that one side of a block holds where holders of a rare shingle meet.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
#: Standard deviations below the similarity at which the values rule a pair out.
SLACK = 4.0
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1024


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """For each multiplier the least product over the shingles, reduced to 16 bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (_ODD[:, None] * hashes[None, at : at + _STEP]).min(axis=1), out=least)
    return (((least ^ (least >> np.uint64(32))) * _ODD[0]) >> np.uint64(48)).astype("<u2")


def node_of(text: str) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), SEED)


def signatures(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (XXH64 of the lower-cased words: rows with equal words share it), fp and sig (MinHash values) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            nodes, prints, sigs = [], [], []
            for text in texts_of(batch, "text"):
                total, n, least = np.zeros(64, dtype=np.int64), 0, np.full(VALUES, np.iinfo(np.uint16).max, dtype="<u2")
                own = list(shingle_hashes(text, width))
                for h in own:
                    total += bits_of(h)
                    n += len(h)
                if n:
                    least = min_hashes(np.concatenate(own))
                nodes.append(node_of(text))
                prints.append(majority(total, n))
                sigs.append(least.tobytes())
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(sigs, pa.binary())], names=["doc_id", "node", "fp", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, node long, fp long, sig binary")


def with_nodes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """node of each row, and the row as the struct `row`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            nodes = np.array([node_of(t) for t in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes)], names=["node"])

    return map_texts(docs, run, "node long", [F.col(text_col).alias("text")], carry=True)


def shingle_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node and its set of shingles, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 64):
            texts = texts_of(batch, "text")
            nodes = np.array([node_of(t) for t in texts], dtype=np.uint64).view(np.int64)
            sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(t, width)])).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, shingles array<long>")


def candidates(classes: DataFrame, budget: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs (a, b) of nodes with close fingerprints or a common band, the nodes of full buckets, and the tables read for them.

    In a bucket of more than BUCKET_MOST nodes each member meets LEADERS of them, the least under
    orders that differ by bucket; a dense group shares many buckets and so meets many leaders.
    What this leaves apart is for crowded_links. So pairs grow in proportion to the nodes.
    """
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("sig", 2 * ROWS * j + 1, 2 * ROWS)) for j in range(BANDS)])
    keyed = classes.select("node", F.explode(keys).alias("key"))
    order = [F.min(F.struct(F.xxhash64("node", "key", F.lit(i)), "node")) for i in range(LEADERS)]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.array(*order).alias("firsts")).where(F.col("n") > 1)
    sizes = sizes.select("key", "n", F.when(F.col("n") > BUCKET_MOST, F.array_distinct("firsts.node")).alias("firsts"))
    shared = written(keyed.join(sizes.hint("merge"), "key"), "band-keys")
    calm = shared.where(F.col("n") <= BUCKET_MOST).select("key", "node")
    met = calm.withColumnRenamed("node", "a").join(calm.withColumnRenamed("node", "b").hint("merge"), "key").where(F.col("a") < F.col("b")).select("a", "b")
    led = shared.where(F.col("n") > BUCKET_MOST).select(F.explode("firsts").alias("a"), F.col("node").alias("b"))
    firsts = written(classes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-firsts")
    close = near_links(firsts.select("fp"), budget)
    left, right = (firsts.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("a", "p"), ("b", "q")))
    near = close.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    same = classes.select("fp", "node").join(firsts.hint("merge"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    crowd = shared.where(F.col("n") > BUCKET_MOST).select("node").distinct()
    all_pairs = met.unionByName(led).unionByName(near).unionByName(same).where(F.col("a") != F.col("b"))
    return all_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), crowd, [shared, firsts]


def crowded_links(sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of `sets` that join all groups which some pair of sets at the similarity joins, exactly.

    Two such sets share one of their rarest shingles: with sizes of at most s they have similarity * s in
    common, so the first s - ceil(similarity * s) + 1 of each under one order hold a common one. Shingles
    whose holders are all of one group give nothing; at the others, those outside the largest
    group meet the rest, in blocks of bounded rows and bytes. A task checks its blocks' whole sets, each pair
    only at the first rare shingle that the two share, and gives just the links that join groups
    which it has not seen joined: rows out grow with the groups, never with pairs.
    """
    rows = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    times = rows.groupBy("s").agg(F.count("*").alias("n"))
    ranked = rows.join(times.hint("merge"), "s").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("all"))
    most = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    rare = F.filter(F.slice("all", F.lit(1), most), lambda x: x["n"] > 1)["s"]
    named = groups.select("node", "component")
    prefix = ranked.select("node", "size", rare.alias("rare")).where(F.size("rare") > 0)
    prefix = written(prefix.join(named.hint("merge"), "node", "left").select("node", "size", "rare", F.coalesce("component", "node").alias("own")), "rare-shingles")
    at = prefix.select("node", "size", "own", F.explode("rare").alias("s"))
    held = at.groupBy("s", "own").agg(F.count("*").alias("n"), F.sum("size").alias("m")).groupBy("s")
    held = held.agg(F.max_by("own", F.struct("n", "own")).alias("major"), F.max_by(F.struct("n", "m"), F.struct("n", "own")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("groups")).where(F.col("groups") > 1)
    blocks = lambda n, m: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(m / BLOCK_SHINGLES))
    held = held.select("s", "major", blocks(F.col("n") - F.col("top.n"), F.col("m") - F.col("top.m")).alias("p"), blocks(F.col("n"), F.col("m")).alias("q"))
    mixed = written(at.join(held.hint("merge"), "s"), "mixed-shingles")
    spread = lambda other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
    left = mixed.where(F.col("own") != F.col("major")).select("s", F.pmod(F.xxhash64("node"), F.col("p")).alias("i"), spread("q").alias("j"), F.lit(True).alias("asks"), "node", F.lit(False).alias("main"))
    right = mixed.select("s", spread("p").alias("i"), F.pmod(F.xxhash64("node"), F.col("q")).alias("j"), F.lit(False).alias("asks"), "node", (F.col("own") == F.col("major")).alias("main"))
    body = prefix.select("node", "own", "rare").join(sets.hint("merge"), "node")
    dealt = left.unionByName(right).join(body.hint("merge"), "node").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "asks", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        def cells() -> Iterator[tuple]:
            for batch in steps(batches, 1024):
                scalars = zip(*(batch.column(c).to_pylist() for c in ("s", "i", "j", "asks", "main", "node", "own")), strict=True)
                for row, rare, shingles in zip(scalars, batch.column("rare"), batch.column("shingles"), strict=True):
                    yield row, rare.values.to_numpy(), shingles.values.to_numpy()

        block, others, out = None, [], []
        for (s, i, j, asks, main, node, own), rare, shingles in cells():
            if block != (s, i, j):
                block, others = (s, i, j), []
            if not asks:
                others.append((node, own, main, rare, shingles, len(shingles)))
                continue
            size, mine, whole = len(shingles), None, None
            for other, theirs, sure, rest, body, n in others:
                if min(size, n) < max(size, n) * similarity - 1e-9 or not (sure or node < other) or top(own) == top(theirs):
                    continue
                mine = mine if mine is not None else set(rare.tolist())
                if next(x for x in rest.tolist() if x in mine) != s:
                    continue
                whole = whole if whole is not None else set(shingles.tolist())
                both = len(whole.intersection(body.tolist()))
                if both >= similarity * (size + n - both):
                    a, b = top(own), top(theirs)
                    root[max(a, b)] = min(a, b)
                    out.append((node, other))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """a, b and the number of values that agree, for pairs that the values do not rule out."""
    floor = VALUES * similarity - SLACK * (VALUES * similarity * (1 - similarity)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, VALUES) for c in ("x", "y"))
            same = (x == y).sum(axis=1)
            keep = np.flatnonzero(same >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")] + [pa.array(same[keep].astype(np.int32))], names=["a", "b", "same"])

    left, right = (classes.select(F.col("node").alias(a), F.col("sig").alias(x)) for a, x in (("a", "x"), ("b", "y")))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, same int")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are in different groups."""
    left, right = (groups.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("a", "u"), ("b", "v")))
    both = pairs.join(left.hint("merge"), "a", "left").join(right.hint("merge"), "b", "left")
    return both.where(F.coalesce("u", "a") != F.coalesce("v", "b")).select(*pairs.columns)


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(a), F.col("shingles").alias(x)) for a, x in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return met.where(F.col("both") >= F.lit(similarity) * (F.col("all") - F.col("both"))).select("a", "b")


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), node and component (its group's name) per row.

    Two documents are linked if the sets of their word shingles have a Jaccard similarity of at least
    `similarity`. Every link is checked on whole texts: first the closest candidate of each node,
    then the pairs still apart, then those that share only full buckets, by their rarest shingles.
    Rows with equal words are one class, so copies never multiply. Texts without words are copies of each other. Rows
    with a null id are grouped too but name no component, unless all ids are null, when it is null. Rows with the same id each give a row.
    """
    prints = written(signatures(docs, width, id_col, text_col), "signatures")
    classes = written(prints.groupBy("node", "fp", "sig").agg(F.min("doc_id").alias("least")), "similar-classes")
    pairs, crowd, used = candidates(classes, budget)
    crowd = written(crowd, "crowded-nodes")
    scored = written(estimated(pairs, classes, similarity), "scored-pairs")
    for table in used:
        discard(table)
    doubt = scored
    links = written(doubt.select("a", "b").limit(0), "no-links")
    groups = written(connected_components(links), "no-groups")
    crowded = not crowd.isEmpty()
    if crowded or not doubt.isEmpty():
        ends = doubt.select(F.col("a").alias("node")).unionByName(doubt.select(F.col("b").alias("node"))).unionByName(crowd).distinct()
        held = written(classes.join(ends.hint("merge"), "node", "left_semi").select("node", "least"), "checked-classes")
        rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
        texts = rows.join(held.where(F.col("least").isNotNull()).select(F.col("least").alias(id_col)).distinct().hint("shuffle_hash"), id_col, "left_semi")
        if not held.where(F.col("least").isNull()).isEmpty():
            texts = texts.unionByName(rows.where(F.col(id_col).isNull()))
        sets = written(shingle_sets(texts, width, id_col, text_col).dropDuplicates(["node"]), "shingle-sets")
        best = doubt.groupBy("b").agg(F.max_by("a", "same").alias("a")).select("a", "b")
        waves = [lambda: _checked(_apart(best, groups), sets, similarity), lambda: _checked(_apart(doubt.select("a", "b"), groups), sets, similarity)]
        if crowded:
            waves.append(lambda: crowded_links(sets.join(crowd.hint("merge"), "node", "left_semi"), groups, similarity))
        for wave in waves:
            links = written(links.unionByName(wave()), "similar-links")
            groups = written(connected_components(links), "similar-groups")
        discard(sets)
    joined = classes.join(groups.hint("merge"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = joined.select("node", "component").distinct().join(named.hint("merge"), "component").select("node", "component", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(labels.hint("merge"), "node").select("doc_id", hexed.alias("fingerprint"), "component_id", "node", "component")
