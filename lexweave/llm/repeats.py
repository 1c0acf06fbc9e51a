"""Removal of byte strings that occur elsewhere, by a run-length index (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, steps, written
from .run_index import RunIndex

#: Bytes of an anchor string; each window of a match's least length has one.
ANCHOR = 48
#: Bytes of contexts that one index takes, about.
INDEX_BYTES = 1 << 20
#: Different contexts of one anchor that meet in an index; of a fuller anchor some are indexed and the others streamed.
GROUP_MOST = 1500
#: Contexts of a fuller anchor that are indexed, about, and that are streamed in one block.
INDEXED, STREAMED = 256, 4096
#: Parts into which the different contexts of an anchor are dealt in joins.
SALTS = 64
#: Window starts that share one core in the count of fuller anchors.
PIECE = 32
_SEGMENT = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    held = _POWERS.get(str(base))
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            held = _POWERS[str(base)] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 14) - 1, base)]), dtype=np.uint64)
    return held[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by prefix and suffix minima of blocks."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: bytes, window: int) -> list[tuple[int, int, int, int]]:
    """(anchor's hash, first start, number of starts, anchor's place after it) for runs of windows that share their anchor.

    The anchor of a window is its string of ANCHOR bytes with the least hash, the first on a tie;
    it depends on the window's bytes alone, so equal windows have equal anchors.
    """
    out: list[tuple[int, int, int, int]] = []
    for base in range(0, len(raw) - window + 1, _SEGMENT):
        part = np.frombuffer(raw, np.uint8)[base : base + _SEGMENT + window - 1]
        n = len(part) - ANCHOR + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part + np.uint64(1)) * _powers(len(part), _BASE), dtype=np.uint64)])
            h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _powers(n, _INVERSE))
        places = np.arange(n, dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        at = (_sliding_min((h & ~low) | places, window - ANCHOR + 1) & low).astype(np.int64)
        edge = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        first = at[edge[:-1]]
        out += zip(h[first].view(np.int64).tolist(), (edge[:-1] + base).tolist(), np.diff(edge).tolist(), (first - edge[:-1]).tolist(), strict=True)
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _sorted_spans(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    return [[(x["start"], x["end"]) for x in (v or [])] for v in batch.column("spans").to_pylist()]


SPANS = "spans array<struct<start: int, end: int>>"
_OPEN = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(docs: DataFrame, window: int = 400, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a string of `window` bytes that also starts anywhere else.

    1. Each text's windows fall into runs with one anchor. The run's context is all bytes of
       its windows; only its hashes are dealt, and anchors seen once end there.
    2. A context that occurs twice is repeated as a whole. Contexts that share an anchor but
       differ meet in a RunIndex, many anchors in one, which gives all their long matches.
    3. An anchor with more than GROUP_MOST different contexts is not gathered: about INDEXED of them make a
       RunIndex, through which the others stream in blocks. Windows whose matching statistic is long enough are
       repeated, here and in the index. The other windows can only be repeated among the streamed: they are counted,
       first PIECE at a time by the bytes that they have in common, then singly where
       that core occurs twice.
    4. The spans go back to the documents, in one join on (id, hash of the text).

    One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (bytes;
    null without `with_text`). Null text is empty; rows with the same id and text are two
    occurrences; an empty table gives no row. Removal may cut inside a character, hence bytes.
    """
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.col(text_col), F.lit(4))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), mark.alias("mark"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out: list[list] = [[] for _ in range(7)]
            for k, m, text in zip(*(batch.column(c).to_pylist() for c in ("key", "mark", "text")), strict=True):
                raw = _bytes(text)
                for h, start, n, lead in anchors(raw, window) if len(raw) >= window else ():
                    whole = xxhash.xxh3_64_intdigest(raw[start : start + n + window - 1])
                    for column, v in zip(out, (h, whole - (1 << 64) if whole >= 1 << 63 else whole, k, m, start, n, lead), strict=True):
                        column.append(v)
            kinds = [*[pa.int64()] * 4, *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["anchor", "context", "key", "mark", "start", "n", "lead"])

    places = written(rows.where(F.octet_length("text") >= window).mapInArrow(find, "anchor long, context long, key long, mark long, start int, n int, lead int"), "anchors")
    salt = F.pmod("context", F.lit(SALTS)).alias("salt")
    parts = places.groupBy("anchor", salt).agg(F.count("*").alias("times"), F.min("context").alias("least"), F.max("context").alias("most"))
    again = _of_all_parts(parts, F.sum("times").alias("times"), (F.min("least") != F.max("most")).alias("mixed")).where(F.col("times") > 1)
    repeated = written(places.withColumn("salt", salt).join(again.select("anchor", "salt", "mixed").hint("merge"), ["anchor", "salt"]), "repeated-anchors")
    discard(places)
    source = F.struct("key", "mark", "start", "n", "lead")
    contexts = repeated.groupBy("anchor", "salt", "context").agg(F.count("*").alias("times"), F.first("mixed").alias("mixed"), F.min(source).alias("at"))
    contexts = written(contexts, "contexts")
    whole = contexts.where(F.col("times") > 1).select("anchor", "context", F.array(F.struct(F.lit(0).alias("start"), (F.col("at.n") + window - 1).cast("int").alias("end"))).alias("spans"))

    mixed = contexts.where("mixed")
    fuller = _of_all_parts(mixed.groupBy("anchor", "salt").agg(F.count("*").alias("many")), F.sum("many").alias("many"))
    asked = mixed.join(fuller.hint("merge"), ["anchor", "salt"]).select("anchor", "context", "times", "many", F.col("at.key").alias("key"), F.col("at.mark").alias("mark"), F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.lead").cast("long").alias("lead"))
    wanted = asked.groupBy("key", "mark").agg(F.collect_list(F.struct("anchor", "context", "many", "lead", "start", "n")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 64):
            out: dict[str, tuple[list, pa.DataType]] = {c: ([], pa.int64()) for c in ("anchor", "context", "many", "lead")} | {"body": ([], pa.binary())}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                raw = _bytes(text)
                for x in own:
                    for c in ("anchor", "context", "many", "lead"):
                        out[c][0].append(x[c])
                    out["body"][0].append(raw[x["start"] : x["start"] + x["n"] + window - 1])
            yield _batch(out)

    bodies = rows.where(F.octet_length("text") >= window).join(wanted, ["key", "mark"]).select("text", "asked").mapInArrow(cut, "anchor long, context long, many long, lead long, body binary")
    bodies = written(bodies, "context-bodies")
    total = bodies.where(F.col("many") <= GROUP_MOST).agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        for batch in batches:
            held.update(zip(zip(batch.column("anchor").to_pylist(), batch.column("context").to_pylist(), strict=True), batch.column("body").to_pylist(), strict=True))
        if not held:
            return
        names = list(held)
        index = RunIndex(list(held.values()))
        at, length = index.long_matches(window)
        string, offset = index.where(at)
        spans: dict[int, list[tuple[int, int]]] = {}
        for s, o, n in zip(string.tolist(), offset.tolist(), length.tolist(), strict=True):
            spans.setdefault(s, []).append((o, o + n))
        found = [(names[s], [{"start": a, "end": b} for a, b in _merged(v)]) for s, v in spans.items()]
        yield _batch({"anchor": ([x[0][0] for x in found], pa.int64()), "context": ([x[0][1] for x in found], pa.int64()), "spans": ([x[1] for x in found], _SPAN)})

    calm = bodies.where((F.col("many") <= GROUP_MOST)).select("anchor", "context", "body").repartition(max(1, -(-total // INDEX_BYTES)), "anchor")
    indexed = calm.mapInArrow(match, f"anchor long, context long, {SPANS}")
    streamed = written(_streamed(bodies.where(F.col("many") > GROUP_MOST), window), "streamed-contexts")
    left = streamed.where(F.size("open") > 0).join(bodies.select("anchor", "context", "lead", "body").hint("merge"), ["anchor", "context"])
    spans = whole.unionByName(indexed).unionByName(streamed.where(F.size("spans") > 0).select("anchor", "context", "spans")).unionByName(_counted(left, window))

    own = repeated.join(spans.hint("merge"), ["anchor", "context"]).select("key", "mark", "start", F.explode("spans").alias("s"))
    own = own.select("key", "mark", F.struct((F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end")).alias("s")).distinct()
    listed = written(own.groupBy("key", "mark").agg(F.collect_list("s").alias("spans")), "removed-spans")
    for table in (repeated, contexts, bodies, streamed):
        discard(table)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = {"doc_id": (batch.column("doc_id").to_pylist(), pa.int64()), **{c: ([], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": ([], pa.string()), "spans": ([], _SPAN), "kept": ([], pa.binary())}
            for text, found in zip(batch.column("text").to_pylist(), _sorted_spans(batch), strict=True):
                raw, gone = _bytes(text), _merged(found)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)], strict=True))
                for c, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("spans", [{"start": a, "end": b} for a, b in gone]), ("kept", kept if with_text else None)):
                    out[c][0].append(v)
            yield _batch(out)

    joined = rows.join(listed, ["key", "mark"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(strip, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {SPANS}, kept binary")


def _of_all_parts(parts: DataFrame, *sums: Column) -> DataFrame:
    """`sums` over all parts of an anchor for each of its parts, so that an anchor's rows stay dealt."""
    return parts.select("anchor", "salt").join(parts.groupBy("anchor").agg(*sums).hint("merge"), "anchor")


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    """First place and length of each run of true values."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(turns[::2], turns[1::2], strict=True)]


def _streamed(bodies: DataFrame, window: int) -> DataFrame:
    """anchor, context, spans that match the anchor's index, and `open`: starts of windows that do not."""
    blocks = F.ceil(F.col("many") / STREAMED)
    held = F.pmod(F.xxhash64("context"), F.col("many")) < INDEXED
    columns = ["anchor", "context", "body"]
    index = bodies.where(held).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(False).alias("asks"))
    others = bodies.where(~held).select(*columns, F.pmod(F.xxhash64("context", F.lit(7)), blocks).alias("block"), F.lit(True).alias("asks"))
    dealt = index.unionByName(others).repartition("anchor", "block").sortWithinPartitions("anchor", "block", "asks", "context")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "asks", "context", "body")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (anchor, block), group in groupby(rows(batches), key=lambda r: r[:2]):
            own = list(group)
            kept, others = [r for r in own if not r[2]], [r for r in own if r[2]]
            found: dict[int, list[tuple[int, int]]] = {r[3]: [] for r in own}
            free: dict[int, list[tuple[int, int]]] = {r[3]: [(0, len(r[4]) - window + 1)] for r in others}
            if kept:
                index = RunIndex([r[4] for r in kept], stream=True)
                marks = [index.long_matches(window)] if block == 0 else []
                for r, (length, place) in zip(others, index.matching_statistics([r[4] for r in others]), strict=True):
                    long = length >= window
                    found[r[3]] = _merged([(int(i), int(i + length[i])) for i in np.flatnonzero(long)])
                    free[r[3]] = _ranges(~long[: len(length) - window + 1])
                    # The longest of each run of overlapping matches stands for those inside it.
                    first = np.flatnonzero(long & ~np.concatenate([[False], long[:-1] & (place[1:] == place[:-1] + 1)]))
                    marks.append((place[first].astype(np.int64), length[first].astype(np.int64)))
                at, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, np.int64),) * 2
                string, offset = index.where(at)
                for s, o, k in zip(string.tolist(), offset.tolist(), n.tolist(), strict=True):
                    found[kept[s][3]].append((o, o + k))
            out = [(name, _merged(spans), free.get(name, [])) for name, spans in found.items() if spans or free.get(name)]
            yield _batch({"anchor": ([anchor] * len(out), pa.int64()), "context": ([x[0] for x in out], pa.int64()), "spans": ([[{"start": a, "end": b} for a, b in x[1]] for x in out], _SPAN), "open": ([[{"start": a, "n": n} for a, n in x[2]] for x in out], _OPEN)})

    return dealt.mapInArrow(run, f"anchor long, context long, {SPANS}, open array<struct<start: int, n: int>>")


def _counted(bodies: DataFrame, window: int) -> DataFrame:
    """Repeated windows among the `open` ones of contexts of which one anchor has very many, by counting hashes."""

    def open_windows(ranges: list[dict], count: int) -> np.ndarray:
        mask = np.zeros(count, dtype=bool)
        for x in ranges:
            mask[x["start"] : x["start"] + x["n"]] = True
        return mask

    def digests(body: bytes, starts: list[int], size: int) -> tuple[list[int], list[int]]:
        both = [xxhash.xxh3_128_intdigest(body[a : a + size]) for a in starts]
        return [(x >> 65) for x in both], [x & ((1 << 63) - 1) for x in both]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1024):
            out = {c: ([], pa.int64()) for c in ("anchor", "context", "h1", "h2")} | {c: ([], pa.int32()) for c in ("start", "n")}
            for a, c, lead, body, ranges in zip(*(batch.column(x).to_pylist() for x in ("anchor", "context", "lead", "body", "open")), strict=True):
                count = len(body) - window + 1
                mask = open_windows(ranges, count)
                for s in range(lead % PIECE - PIECE if lead % PIECE else 0, count, PIECE):  # told off from the anchor
                    if not mask[max(s, 0) : s + PIECE].any():
                        continue
                    h1, h2 = digests(body, [s + PIECE - 1], window - PIECE + 1)
                    first = max(s, 0)
                    for k, v in (("anchor", a), ("context", c), ("h1", h1[0]), ("h2", h2[0]), ("start", first), ("n", min(s + PIECE, count) - first)):
                        out[k][0].append(v)
            yield _batch(out)

    cores = written(bodies.mapInArrow(pieces, "anchor long, context long, h1 long, h2 long, start int, n int"), "cores")
    twice = cores.groupBy("h1", "h2").agg(F.count("*").alias("times")).where(F.col("times") > 1)
    left = cores.join(twice, ["h1", "h2"]).groupBy("anchor", "context").agg(F.collect_list(F.struct("start", "n")).alias("pieces"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 256):
            out = {c: ([], pa.int64()) for c in ("anchor", "context", "h1", "h2")} | {"start": ([], pa.int32())}
            for a, c, body, ranges, own in zip(*(batch.column(x).to_pylist() for x in ("anchor", "context", "body", "open", "pieces")), strict=True):
                mask = open_windows(ranges, len(body) - window + 1)
                starts = [s for x in own for s in range(x["start"], x["start"] + x["n"]) if mask[s]]
                h1, h2 = digests(body, starts, window)
                for k, v in (("anchor", [a] * len(starts)), ("context", [c] * len(starts)), ("h1", h1), ("h2", h2), ("start", starts)):
                    out[k][0].extend(v)
            yield _batch(out)

    singles = written(bodies.join(left, ["anchor", "context"]).mapInArrow(windows, "anchor long, context long, h1 long, h2 long, start int"), "windows")
    again = singles.groupBy("h1", "h2").agg(F.count("*").alias("times")).where(F.col("times") > 1)
    hit = singles.join(again, ["h1", "h2"]).groupBy("anchor", "context").agg(F.collect_list(F.struct("start", (F.col("start") + window).cast("int").alias("end"))).alias("spans"))
    return hit.select("anchor", "context", "spans")
