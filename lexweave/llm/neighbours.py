"""Nearest neighbours by shifted space-filling curves, then bounded completion (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .hilbert import hilbert_keys

#: Curves, projected dimensions, bits of each; rows of a block, and ranks on either side of a query.
CURVES, DIMS, BITS, BLOCK, REACH = 3, 6, 8, 512, 512
#: Query classes that one completion task takes.
QUERY_BLOCK = 2048
#: Queries of one matrix product, and blocks that are scored together.
SCORE_ROWS, PAGE = 256, 16
#: Outlines of blocks that one task compares with a block of queries.
SHAPE_PAGE = 4096


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)


def _usable(c: Column) -> Column:
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def _projection(curve: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(1000 + curve)
    return np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : min(DIMS, dim)]


def _renewed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as new ones, so that a frame can meet another made from it."""
    return df.select(*[F.col(c).alias(c) for c in names])


def _in_order(q: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of q and columns j of p, summed from the first component to the last."""
    total = np.zeros(len(i))
    for d in range(len(p)):
        total += q[i, d] * p[d, j]
    return total


def _score(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best classes among the points for each query class, ties to smaller names; none below its `kth` where it has one.

    A matrix product rounds by its shape, so all that may be among the best within the bound of rounding are kept, summed
    in order and cut by that sum.
    """
    names, asked = points["cls"].to_numpy(), queries["cls"].to_numpy()
    floor = queries["kth"].to_numpy() if "kth" in queries else np.full(len(queries), -np.inf)
    q, p = _matrix(queries["embedding"]), _matrix(points["embedding"]).T
    slack = 4 * (len(p) + 2) * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=0).max(initial=0)
    out = []
    for at in range(0, len(q), SCORE_ROWS):
        own = q[at : at + SCORE_ROWS]
        g = own @ p
        least = np.partition(g, -k, axis=1)[:, -k] if g.shape[1] > k else np.full(len(g), -np.inf)
        i, j = np.nonzero(g >= (np.maximum(least, floor[at : at + SCORE_ROWS]) - slack[at : at + SCORE_ROWS])[:, None])
        score = _in_order(own, p, i, j)
        order = np.lexsort((names[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        out.append(pd.DataFrame({"query": asked[at + i[best]], "near": names[j[best]], "score": score[best]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, complete: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for each row whose id is divisible by `query_every`.

    1. Equal vectors make a class, named by its smallest id; it keeps the k + 1 smallest ids,
       as no query can need more of them (the limit runs before the shuffle).
    2. For each curve the classes are projected by a fixed rotation into a cube of half the grid's side, which is shifted
       by a third of that side from curve to curve, put on the grid and sorted by Hilbert key; range partitions and their counts give every
       class its rank. A query meets the blocks that its window of ranks touches; the
       windows of all curves merge and are reranked by the exact inner product.
    3. With `complete`, every block of the first curve whose bound |q||p| or q.c + |q|r (c its
       centre, r its radius) reaches the query's k-th score so far is scored too, in blocks of
       queries, so the result is exact whatever the data; without it, it is approximate.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those whose
    length is not the most common one, take no part; nor do null ids. Rows with the same id are
    one candidate each. An empty table gives no row.
    """
    c = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(_usable(c) & F.col("vec_id").isNotNull())
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1
    rows = rows.where(F.size("embedding") == dim).withColumn("embedding", c.cast("array<double>"))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.sort_array(F.collect_list("vec_id")).alias("members")), "vector-classes")
    spark = vectors.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // 4096)))
    seeks = written(rows.where(F.col("vec_id") % query_every == 0).join(classes.select("embedding", "cls"), "embedding").select("vec_id", "cls"), "vector-queries")
    asked = classes.join(seeks.select("cls").distinct(), "cls", "left_semi")

    def curve_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _matrix(frame["embedding"])
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            for curve in range(CURVES):
                y = unit @ _projection(curve, dim)
                cells = (np.clip(y * np.sqrt(dim) / 6 + 0.5, 0, 1) + curve / CURVES) / 2 * (1 << BITS)
                grid = np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1)
                yield pd.DataFrame({"curve": curve, "key": hilbert_keys(grid, BITS), "cls": frame["cls"], "embedding": frame["embedding"]})

    kinds = T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    keyed = written(classes.mapInPandas(curve_keys, kinds).repartitionByRange(CURVES * parts, "curve", "key", "cls").sortWithinPartitions("curve", "key", "cls").withColumn("part", F.spark_partition_id()), "curves")
    counts = keyed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "cls")) - 1
    ranked = keyed.withColumn("local", local).join(F.broadcast(base), ["curve", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    blocked = written(ranked.select("curve", "rank", F.floor(F.col("rank") / BLOCK).alias("block"), "cls", "embedding"), "curve-blocks")
    wanted = blocked.join(asked.select("cls"), "cls", "left_semi").withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("rank") - REACH, F.lit(0)) / BLOCK), F.floor((F.col("rank") + REACH) / BLOCK))))

    def in_block(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        return _score(queries, points, k + 1) if len(queries) and len(points) else pd.DataFrame({"query": [], "near": [], "score": []})

    found_schema = "query long, near long, score double"
    keys = ["curve", "block"]
    found = _renewed(wanted, *keys, "cls", "embedding").groupBy(*keys).cogroup(blocked.select(*keys, "cls", "embedding").groupBy(*keys)).applyInPandas(in_block, found_schema)

    def best(df: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))
        return df.dropDuplicates(["query", "near"]).withColumn("place", place).where(F.col("place") <= k + 1).drop("place")

    found = written(best(found), "neighbours")
    if complete:
        found = best(found.unionByName(_complete(asked, blocked, found, k)))
    # The scores that are given out are summed by Spark, in the same order.
    left = classes.select(F.col("cls").alias("query"), F.col("embedding").alias("asks"))
    near = classes.select(F.col("cls").alias("near"), F.col("embedding").alias("has"), "members")
    exact = F.aggregate(F.zip_with("asks", "has", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    found = found.join(near, "near").join(left, "query").select("query", "near", "members", exact.alias("score"))
    listed = found.join(seeks.select(F.col("cls").alias("query"), F.col("vec_id").alias("query_id")), "query")
    listed = listed.select("query_id", "score", F.explode("members").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _complete(asked: DataFrame, blocked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Score the blocks of the first curve that can still hold one of a query's k + 1 best."""
    first = blocked.where(F.col("curve") == 0).select("block", "cls", "embedding")

    def shape(points: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(points["embedding"])
        centre = x.mean(axis=0)
        return pd.DataFrame({"block": [points["block"].iloc[0]], "centre": [centre.tolist()], "radius": [float(np.linalg.norm(x - centre, axis=1).max())], "longest": [float(np.linalg.norm(x, axis=1).max())]})

    shapes = written(first.groupBy("block").applyInPandas(shape, "block long, centre array<double>, radius double, longest double"), "blocks")
    kth = found.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("kth"))
    groups = F.pmod(F.xxhash64("cls"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK))))
    q = written(asked.join(kth.withColumnRenamed("query", "cls"), "cls", "left").select(groups.alias("grp"), "cls", "embedding", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")), "completion-queries")
    groups_n, pages_n = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-shapes.count() // SHAPE_PAGE))
    each_page = q.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages_n - 1))))
    page = F.pmod(F.floor(F.col("block") / PAGE), F.lit(pages_n)).cast("int")
    each_group = shapes.withColumn("page", page).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups_n - 1).cast("long"))))

    def reach(queries: pd.DataFrame, outlines: pd.DataFrame) -> pd.DataFrame:
        pages: dict[int, tuple[set, set]] = {}
        if len(queries) and len(outlines):
            x, floor, names = _matrix(queries["embedding"]), queries["kth"].to_numpy(), queries["cls"].to_numpy()
            norm = np.linalg.norm(x, axis=1)
            for o in outlines.itertuples():
                bound = np.minimum(norm * o.longest, x @ np.asarray(o.centre) + norm * o.radius)
                near = names[bound + 1e-9 * norm * o.longest >= floor]
                if len(near):
                    blocks, own = pages.setdefault(int(o.block) // PAGE, (set(), set()))
                    blocks.add(int(o.block))
                    own.update(near.tolist())
        grp = int(queries["grp"].iloc[0]) if len(queries) else 0
        return pd.DataFrame([(grp, page, sorted(blocks), sorted(own)) for page, (blocks, own) in pages.items()], columns=["grp", "page", "block", "cls"])

    # A row for each group of queries and page: its blocks and queries by name; vectors are joined once a page.
    keys = ["grp", "page"]
    met = each_page.groupBy(*keys).cogroup(_renewed(each_group, *each_group.columns).groupBy(*keys)).applyInPandas(reach, "grp long, page long, block array<long>, cls array<long>")
    met = written(met, "completion-pairs")
    wanted = met.select("grp", "page", F.explode("block").alias("block")).distinct()
    points = _renewed(first.join(wanted, "block"), "grp", "page", "cls", "embedding")
    asks = met.select("grp", "page", F.explode("cls").alias("cls")).distinct().join(_renewed(q, "grp", "cls", "embedding", "kth"), ["grp", "cls"])

    def in_pair(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        return _score(queries, points, k + 1) if len(queries) and len(points) else pd.DataFrame({"query": [], "near": [], "score": []})

    return asks.groupBy("grp", "page").cogroup(points.groupBy("grp", "page")).applyInPandas(in_pair, "query long, near long, score double")
