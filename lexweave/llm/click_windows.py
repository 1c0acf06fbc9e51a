"""Expiring deduplication of clicks by two chained stateful operators of one streaming query.

The first keeps the open window of every click (opener and deadline), tags each row with its window and says when a window
ends. The second keeps the counters of every window and gives them out when that word reaches it. What ends a window
without a later row is a control row: each batch brings one to every bucket, with the hour below which rows are late and the
hour below which deadlines have passed. Control rows travel as data, so they need no timer and survive a restart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import move, scratch_folder, with_settings

#: A window takes rows up to so many hours after its opener; rows more than LATENESS hours behind are dropped.
SPAN, LATENESS, BATCHES = 24, 96, 8
#: Rows of one batch that a bucket of clicks is meant to have, and rows that it gathers before equal ones are added up.
BUCKET_ROWS, GATHERED = 20_000, 200_000
#: Where the operators keep their state: in the checkpoint, a file a partition and batch. A task reads its partition's and holds it
#: until it ends; no version stays in an executor. (Each start opens all stores anew. Spark's RocksDB stores don't free the
#: native statistics of a store that is closed, about half a MB each, so with them an executor would grow with every start.)
_STORE = "spark.sql.streaming."
STATE_STORE = {_STORE + "stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", _STORE + "maxBatchesToRetainInMemory": "0", _STORE + "stateStore.unloadOnCommit": "true"}
#: Spark refuses a second operator of this kind in one query whatever its timeouts; these two have neither timeout nor watermark.
CHAINED = {_STORE + "unsupportedOperationCheck": "false"}
NEVER, ALWAYS = -(2**31), 2**31 - 1

FEED = "click_id long, hour int, client_id long, kind string, value double, ts timestamp_ntz, props string, third int, batch int"
TICK = "bucket int, floor_hour int, close_before int, batch int"
EVENT = "click_id long, start_hour int, opens boolean, hash binary, rows long, closed_batch int"
WINDOW = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
RESULT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"

_OPEN = np.dtype([("click", "<i8"), ("start", "<i8"), ("h", "<u8", 4)])
_COUNTED = np.dtype([("click", "<i8"), ("start", "<i8"), ("h", "<u8", 4), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8")])


def _micros(ts):
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(30, 6)) * 1000000 as bigint)")


def click_copies(clicks: DataFrame) -> DataFrame:
    """Every row of `clicks` as often as its id says, with `hour` and the place `level` that deals it to a batch.

    Rows without click_id or arrived_at have no place and go; other nulls stay.
    """
    rows = clicks.select("click_id", F.col("arrived_at").cast("timestamp_ntz").alias("arrived"), "client_id", "kind", "value", F.col("ts").cast("timestamp_ntz").alias("ts"), "props")
    rows = rows.where(F.col("click_id").isNotNull() & F.col("arrived").isNotNull())
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))))
    rows = rows.withColumns({"c": F.crc32(F.concat_ws(":", "click_id", "j")), "m": _micros("arrived")})
    rows = rows.withColumn("hour", F.expr("cast((m - pmod(m, 3600000000)) div 3600000000 + 6 * j * (c % 10) as int)"))
    return rows.select("click_id", "hour", "client_id", "kind", F.col("value").cast("double").alias("value"), "ts", "props", F.expr("cast(c % 3 as int)").alias("third"), F.expr("hour + (c div 10) % 200").alias("level"))


def _hashed(rows: DataFrame):
    """The SHA-256 of what a copy says; values that are no number count as missing."""
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.floor(100 * F.col("value") + 0.5).cast("long"))
    parts = [F.col("client_id"), F.col("kind"), value, _micros("ts"), F.col("props"), F.col("third")]
    text = F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("|"))][:-1])
    return F.unhex(F.sha2(text, 256))


def _gathered(frames: Iterable[pd.DataFrame], names: list[str], keys: list[str], add: str) -> dict[str, np.ndarray]:
    """Columns of all frames, hashes as four words; beyond GATHERED rows equal ones are added up."""
    parts: list[dict[str, np.ndarray]] = []
    n = 0

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    for f in frames:
        own = {k: f[k].to_numpy() for k in names}
        own["h"] = np.frombuffer(b"".join(x or bytes(32) for x in f["hash"]), dtype=">u8").astype("<u8").reshape(-1, 4)
        parts.append(own)
        n += len(f)
        if n > GATHERED:
            parts = [_summed(joined(), keys, add)]
            n = GATHERED // 2 if len(parts[0]["h"]) < GATHERED // 2 else 0
    return joined() if parts else {}


def _summed(x: dict[str, np.ndarray], keys: list[str], add: str) -> dict[str, np.ndarray]:
    order = np.lexsort([*x["h"].T[::-1], *[x[k] for k in reversed(keys)]])
    x = {k: v[order] for k, v in x.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = (x["h"][1:] != x["h"][:-1]).any(axis=1) | np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in keys])
    at = np.flatnonzero(fresh)
    total = np.add.reduceat(x[add], at) if len(at) else x[add]
    return {k: v[at] for k, v in x.items()} | {add: total}


def _hashes(h: np.ndarray) -> list[bytes]:
    raw = h.astype(">u8").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def _tag_batch(kept: np.ndarray, rows: dict[str, np.ndarray], batch: int, close_before: int, span: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Windows open afterwards, and events. `kept` has one window a click, by click; rows are by click, hour and hash."""
    click, hour, h = rows["click_id"], rows["hour"].astype(np.int64), rows["h"]
    n = len(click)
    first = np.flatnonzero(np.r_[True, click[1:] != click[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[first[1:], n] if n else first
    owners = click[first]
    base = int(hour.min()) if n else 0
    width = (int(hour.max()) - base + 2) if n else 1
    rank = np.repeat(np.arange(len(first)), ends - first)
    key = rank * width + (hour - base)

    at = np.searchsorted(kept["click"], owners)
    known = np.zeros(len(owners), bool)
    inside = at < len(kept)
    known[inside] = kept["click"][at[inside]] == owners[inside]

    window = np.empty(n, np.int64)  # of each row: a number in `made`
    made = [kept]
    opener = np.full(n, False)
    last: list[tuple[np.ndarray, np.ndarray]] = []  # windows that a later row ends, and where their rows end
    count = len(kept)

    def take(who: np.ndarray, start: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rows from `pos` on up to the deadline get the window's number; where they end."""
        until = np.searchsorted(key, who * width + np.clip(start + span + 1 - base, 0, width - 1))
        until = np.maximum(until, pos)
        lengths = until - pos
        spots = np.repeat(pos - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        window[spots] = np.repeat(ids, lengths)
        more = until < ends[who]
        last.append((ids[more], until[more]))
        return until

    pos = first.copy()
    if known.any():
        who = np.flatnonzero(known)
        pos[who] = take(who, kept["start"][at[who]], pos[who], at[who])
    while True:
        who = np.flatnonzero(pos < ends)
        if not len(who):
            break
        fresh = np.zeros(len(who), _OPEN)
        fresh["click"], fresh["start"], fresh["h"] = owners[who], hour[pos[who]], h[pos[who]]
        opener[pos[who]] = True
        ids = count + np.arange(len(who))
        made.append(fresh)
        count += len(who)
        pos[who] = take(who, fresh["start"], pos[who], ids)

    every = np.concatenate(made)
    closed = np.zeros(count, bool)
    for ids, _ in last:
        closed[ids] = True
    closed |= every["start"] + span < close_before
    told = np.full(n, -1, np.int32)
    ending = np.flatnonzero(closed[window] & np.r_[window[1:] != window[:-1], True]) if n else np.zeros(0, np.int64)
    told[ending] = batch
    alone = closed.copy()
    alone[window] = False  # windows without a row of this batch get word of their end by itself
    alone = np.flatnonzero(alone)
    m = len(alone)
    none = np.zeros((m, 4), "<u8")
    events = {
        "click_id": np.r_[click, every["click"][alone]],
        "start_hour": np.r_[every["start"][window], every["start"][alone]],
        "opens": np.r_[opener, np.zeros(m, bool)],
        "h": np.concatenate([h, none]),
        "rows": np.r_[rows["rows"], np.zeros(m, np.int64)],
        "closed_batch": np.r_[told, np.full(m, batch, np.int32)],
    }
    still = every[~closed]
    return still[np.argsort(still["click"], kind="stable")], events


STATE = "kept binary"


class _Kept:
    """A bucket's state is one array, kept as bytes."""

    kind: np.dtype

    def load(self, state: GroupState) -> np.ndarray:
        return np.frombuffer(bytes(state.get[0]), self.kind) if state.exists else np.zeros(0, self.kind)

    def store(self, state: GroupState, kept: np.ndarray) -> None:
        if len(kept):
            state.update((kept.tobytes(),))
        elif state.exists:
            state.remove()


class TagWindows(_Kept):
    """First operator: keeps the open windows of a bucket of clicks; rows and control rows in, events out."""

    kind = _OPEN

    def __init__(self, span: int = SPAN):
        self.span = span

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = self.load(state)
        x = _gathered(rows, ["tick", "batch", "click_id", "hour", "rows", "floor_hour", "close_before"], ["tick", "batch", "click_id", "hour"], "rows")
        for batch in np.unique(x["batch"]):  # one, or more where an earlier start was lost before it began
            own = x["batch"] == batch
            tick = np.flatnonzero(own & x["tick"])[0]
            data = {k: v[own & ~x["tick"] & (x["hour"] >= x["floor_hour"][tick])] for k, v in x.items()}
            data = _summed(data, ["click_id", "hour"], "rows")
            kept, events = _tag_batch(kept, data, int(batch), int(x["close_before"][tick]), self.span)
            if len(events["click_id"]):
                events["hash"] = _hashes(events.pop("h"))
                yield pd.DataFrame(events)[["click_id", "start_hour", "opens", "hash", "rows", "closed_batch"]]
        self.store(state, kept)


class CountWindows(_Kept):
    """Second operator: keeps the counters of a bucket of windows; events in, closed windows out."""

    kind = _COUNTED

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e = _gathered(rows, ["click_id", "start_hour", "opens", "rows", "closed_batch"], ["click_id", "start_hour", "opens", "closed_batch"], "rows")
        opens = e["opens"].astype(bool)
        fresh = np.zeros(int(opens.sum()), _COUNTED)
        fresh["click"], fresh["start"], fresh["h"] = e["click_id"][opens], e["start_hour"][opens], e["h"][opens]
        kept = np.concatenate([self.load(state), fresh])
        kept = kept[np.lexsort([kept["start"], kept["click"]])]
        clicks = np.unique(kept["click"])
        low = min(int(kept["start"].min()), int(e["start_hour"].min()))
        width = max(int(kept["start"].max()), int(e["start_hour"].max())) - low + 1
        place = lambda click, start: np.searchsorted(clicks, click) * width + (start - low)
        keys, asked = place(kept["click"], kept["start"]), place(e["click_id"], e["start_hour"].astype(np.int64))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        if (keys[at] != asked).any() or (kept["click"][at] != e["click_id"]).any():
            raise ValueError("an event names a window that was never opened")
        np.add.at(kept["repeats"], at, e["rows"] - opens)
        odd = np.flatnonzero((e["rows"] > 0) & ~opens & (e["h"] != kept["h"][at]).any(axis=1))
        np.add.at(kept["conflicts"], at[odd], e["rows"][odd])
        crc = np.fromiter((zlib.crc32(x.hex().encode()) for x in _hashes(e["h"][odd])), np.int64, len(odd))
        np.add.at(kept["crc"], at[odd], crc * e["rows"][odd])
        closed = np.full(len(kept), -1, np.int64)
        told = e["closed_batch"] >= 0
        closed[at[told]] = e["closed_batch"][told]
        gone = kept[closed >= 0]
        if len(gone):
            columns = {"click_id": gone["click"], "start_hour": gone["start"], "closed_batch": closed[closed >= 0], "n_repeats": gone["repeats"], "n_conflicts": gone["conflicts"], "conflict_crc": gone["crc"], "hash": _hashes(gone["h"])}
            yield pd.DataFrame(columns)
        self.store(state, kept[closed < 0])


def window_stream(spark: SparkSession, rows_path: str, ticks_path: str, buckets: int, span: int = SPAN) -> DataFrame:
    """The streaming frame of closed windows over folders of rows (FEED) and control rows (TICK), by batch."""
    rows = spark.readStream.schema(FEED).parquet(rows_path)
    zero = F.lit(0)
    data = rows.select(F.pmod(F.xxhash64("click_id"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(False).alias("tick"), "batch", "click_id", "hour", _hashed(rows).alias("hash"), F.lit(1).cast("long").alias("rows"), zero.alias("floor_hour"), zero.alias("close_before"))
    ticks = spark.readStream.schema(TICK).parquet(ticks_path)
    ticks = ticks.select("bucket", F.lit(True).alias("tick"), "batch", zero.cast("long").alias("click_id"), zero.alias("hour"), F.lit(b"").alias("hash"), F.lit(0).cast("long").alias("rows"), "floor_hour", "close_before")
    tagged = data.unionByName(ticks).groupBy("bucket").applyInPandasWithState(TagWindows(span), EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
    dealt = tagged.withColumn("part", F.pmod(F.xxhash64("click_id", "start_hour"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("part").applyInPandasWithState(CountWindows(), WINDOW, STATE, "append", GroupStateTimeout.NoTimeout)


def deduplicate_clicks(clicks: DataFrame, batches: int = BATCHES, span: int = SPAN, lateness: int = LATENESS) -> DataFrame:
    """Windows of repeated clicks: click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash.

    Copies are cut into `batches` folders under spark.checkpoint.dir. Each is moved to where the query looks and the query
    is started for it, on one checkpoint, which holds both operators' state; results go to a Parquet sink that counts a
    batch once. A new folder serves every call.

    Buckets of clicks, not single clicks, are the groups: their number follows the rows, so that a group has about
    BUCKET_ROWS rows a batch and its state is one small array. Equal rows (click, hour and hash) are added up as they are
    gathered. An empty table gives no windows and starts nothing. Ties in hour and hash are equal rows.
    """
    spark = clicks.sparkSession
    copies = click_copies(clicks)
    low, high = copies.agg(F.min("level"), F.max("level")).first()
    if low is None:
        return spark.createDataFrame([], RESULT)
    home = scratch_folder(spark, "click-windows")
    dealt = copies.withColumn("batch", F.expr(f"cast((level - {low}) * {batches} div {high - low + 1} as int)")).drop("level")
    dealt.write.partitionBy("batch").option("compression", "zstd").parquet(f"{home}/staged")
    found = {r["batch"]: r for r in spark.read.schema(FEED).parquet(f"{home}/staged").groupBy("batch").agg(F.max("hour").alias("top"), F.count("*").alias("n")).collect()}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8 * partitions, max(r["n"] for r in found.values()) // BUCKET_ROWS)
    top = None
    for batch in range(batches):
        floor = NEVER if top is None else top - lateness
        own = found.get(batch)
        top = max(x for x in (top, own and own["top"]) if x is not None)
        ticks = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(floor).alias("floor_hour"), F.lit(ALWAYS if batch == batches - 1 else top - lateness).alias("close_before"))
        ticks.repartition(max(1, buckets // 1_000_000)).write.parquet(f"{home}/ticks/batch={batch}")
        if own:
            move(spark, f"{home}/staged/batch={batch}", f"{home}/rows/batch={batch}")
        windows = window_stream(spark, f"{home}/rows", f"{home}/ticks", buckets, span)
        with with_settings(spark, STATE_STORE | CHAINED):
            query = windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/windows")
            query.awaitTermination()
    out = spark.read.schema(T.StructType.fromDDL(WINDOW)).parquet(f"{home}/windows")
    return out.withColumn("hash", F.lower(F.hex("hash")))
