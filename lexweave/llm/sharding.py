"""Sharding by vector bin packing over bytes, tokens and rows (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A group with more than this share of a shard's bytes or rows is placed before all others, whole if a shard can hold its bytes.
HOT_SHARE = 1 / 32
#: Weights of bytes, tokens and rows in the dot product, and what they count at least once a shard is full: bytes, whose law
#: must hold, without end, the others nothing.
WEIGHTS, FLOOR = np.array([1.0, 0.005, 0.005]), np.array([-np.inf, 0.0, 0.0])
#: Rows that one placing task takes.
TASK_ROWS = 100_000


def place(sizes: np.ndarray, shards: int, turn: int = 0, room: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """Shard of each group; `sizes` has one row of (bytes, tokens, rows) a group.

    The largest group goes first. Each goes where the dot product of its size with what the
    shard can still take is highest, all in shares of a shard's part of the total. `room` gives what the shards
    can take at first, `total` the sums of which the groups are a part.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    share = sizes / np.maximum((sizes.sum(axis=0) if total is None else total) / shards, 1e-9)
    free = np.ones((shards, sizes.shape[1])) if room is None else np.roll(room, -turn, axis=0).astype(float)
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-share.sum(axis=1), kind="stable"):
        best = int(np.argmax(np.where(free > FLOOR, free, FLOOR) @ (share[i] * WEIGHTS)))
        out[i] = best
        free[best] -= share[i]
    return (out + turn) % shards


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: doc_id, size, tokens, text_crc32, shard, slot.

    Rows with equal texts make a group that stays together where one shard can hold it: groups with more than HOT_SHARE
    of a shard's bytes, or of its rows, are placed first, all at once; by their sizes there are at most 2 * shards / HOT_SHARE of
    them, which bounds what the driver holds and broadcasts, and no other group fills a task. Only one larger than a shard is cut, by a hash of the id. All
    others are dealt to tasks of about TASK_ROWS rows by a hash; each task balances its own groups over what the first
    ones left in all shards, so the sums balance. Size
    is the UTF-8 bytes plus 16, tokens are counted by blanks. slot numbers the rows of a
    shard without gaps, from counts per task. Null text has size 16 and groups with null;
    rows with the same id are placed each for itself; an empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text_col), F.lit(8)).alias("text_key"),
    )
    rows = written(rows, "shard-rows")
    group = ["text_key", "text_crc32", "size"]
    sums = ["size", "tokens"]
    totals = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first()
    limit = totals["size"] / shards
    many = max(totals["n"] / shards * HOT_SHARE, 1)
    hot = rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > limit * HOT_SHARE) | (F.col("n") > many)).collect()
    cut = spark.createDataFrame([(*[r[c] for c in group], max(1, -(-r["bytes"] // max(1, int(limit))))) for r in hot], "text_key long, text_crc32 long, size long, parts long")
    salted = rows.join(F.broadcast(cut), group, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0).cast("long")))
    known = salted.where(F.col("parts").isNotNull()).groupBy(*group, "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("words"), F.count("*").alias("rows"))
    firsts = known.orderBy(*group, "part").collect()
    total = np.array([totals["size"], totals["tokens"], totals["n"]], dtype=float)
    loads = np.array([[r["bytes"], r["words"], r["rows"]] for r in firsts], dtype=float).reshape(-1, 3)
    at = place(loads, shards, total=total)
    used = np.stack([np.bincount(at, loads[:, c], shards) for c in range(3)], axis=1) / np.maximum(total / shards, 1e-9)
    left = 1 - used
    room = np.where(left.mean(axis=0) > 1e-6, left / np.maximum(left.mean(axis=0), 1e-6), 1.0)
    known = spark.createDataFrame([(*[r[c] for c in group], r["part"], int(shard)) for r, shard in zip(firsts, at, strict=True)], "text_key long, text_crc32 long, size long, part long, first int")
    salted = salted.drop("parts").join(F.broadcast(known), [*group, "part"], "left")
    tasks = max(1, -(-totals["n"] // TASK_ROWS))

    def balance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        own = pd.concat(parts, ignore_index=True) if parts else None
        if own is None or own.empty:
            return
        task = TaskContext.get().partitionId()
        shard = own["first"].to_numpy(dtype=float)
        free = np.isnan(shard)
        mine = own[free]
        if len(mine):
            at = mine.groupby(["text_key", "text_crc32", "size"], sort=True).ngroup().to_numpy()
            n = int(at.max()) + 1
            sizes = np.stack([np.bincount(at, mine[c], n) for c in ("size", "tokens")] + [np.bincount(at, minlength=n)], axis=1)
            shard[free] = place(sizes, shards, task % shards, room)[at]
        own["shard"] = shard.astype(np.int32)
        own = own.sort_values(["shard", "doc_id", "text_crc32"], kind="stable")
        own["task"] = task
        own["local"] = own.groupby("shard").cumcount()
        yield own[["doc_id", "size", "tokens", "text_crc32", "shard", "task", "local"]]

    # Rows whose shard is known are dealt by themselves, so that no group fills a task.
    deal = F.when(F.col("first").isNull(), F.col("text_key")).otherwise(F.xxhash64("doc_id", "text_key"))
    dealt = salted.repartition(tasks, deal).mapInPandas(balance, "doc_id long, size long, tokens long, text_crc32 long, shard int, task int, local long")
    placed = written(dealt, "shards")
    counts = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(base, ["shard", "task"]).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("local")).alias("slot"))
