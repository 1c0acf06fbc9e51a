"""Entries of large JSON lists and objects, read in blocks by many tasks.

A file is cut at its commas, wherever they stand, so a block of any size has many short pieces and none is held whole. One
look at a block tells, for either case, whether it begins inside a string or not, how it changes that and the nesting,
and at which nestings its pieces end. These few numbers a block are put together in order; then every block knows where it
begins and which of its commas part entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.S)
_NEST = re.compile(r"[\[\]{}]")
SUMMARY = "file string, block long, odd boolean, change0 int, change1 int, ends0 array<int>, ends1 array<int>, first string"
#: The entry that is open at a block's end stands after all others of the block.
_LAST = 1 << 62
PART = "file string, owner long, seq long, block long, whole boolean, text string"


def piece_change(piece: str) -> tuple[bool, int, int]:
    """Whether a piece has an odd number of quotation marks, and its change of nesting if it begins outside, or inside, a string."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    change = [0, 0]
    parts = piece.split('"')
    for i, part in enumerate(parts):
        for c in _NEST.findall(part):
            change[i & 1] += 1 if c in "[{" else -1
    return len(parts) % 2 == 0, change[0], change[1]


@dataclass
class Start:
    """How a block begins: inside a string, at what nesting, in an entry of which block; and the kind of its file."""

    inside: bool
    depth: int
    owner: int
    kind: str


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist(), strict=True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for file, block, piece in _keyed(batches):
        if now is None or (now["file"], now["block"]) != (file, block):
            now = {"file": file, "block": block, "odd": False, "change0": 0, "change1": 0, "ends0": set(), "ends1": set(), "first": piece.lstrip("﻿ \t\r\n")[:1]}
            out.append(now)
        odd, outside, inside = piece_change(piece)
        for start in (0, 1):
            at = start ^ now["odd"]
            now[f"change{start}"] += inside if at else outside
        now["odd"] ^= odd
        for start in (0, 1):
            if not start ^ now["odd"]:
                now[f"ends{start}"].add(now[f"change{start}"])
    for row in out:
        row["ends0"], row["ends1"] = sorted(row["ends0"]), sorted(row["ends1"])
    kinds = {"file": pa.string(), "block": pa.int64(), "odd": pa.bool_(), "change0": pa.int32(), "change1": pa.int32(), "ends0": pa.list_(pa.int32()), "ends1": pa.list_(pa.int32()), "first": pa.string()}
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))


def starts_of(summaries: list) -> dict[tuple[str, int], Start]:
    """Where each block begins, from the blocks before it in its file."""
    out: dict[tuple[str, int], Start] = {}
    file, at, depth, owner, kind = None, 0, 0, 0, ""
    for s in [*sorted(summaries, key=lambda s: (s["file"], s["block"])), None]:
        if s is None or s["file"] != file:
            if file is not None and (at or depth):
                raise ValueError(f"{file} ends inside a value")
            if s is None:
                break
            file, at, depth, owner, kind = s["file"], 0, 0, s["block"], s["first"]
            if kind not in ("[", "{"):
                raise ValueError(f"{file} holds neither a list nor an object")
        out[s["file"], s["block"]] = Start(bool(at), depth, owner, kind)
        if 1 - depth in s[f"ends{at}"]:  # one of its commas parts entries, so what is open at its end began in it
            owner = s["block"]
        depth += s[f"change{at}"]
        at ^= int(s["odd"])
    return out


def _parts(starts: dict[tuple[str, int], Start]):
    """Entries that lie within a block, and the parts of those that don't, with the block that they began in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("seq", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
        out: list[dict] = []
        key, held, seq, head = None, [], 0, False
        inside, depth = False, 0

        def close(ended: bool) -> None:
            nonlocal held, seq, head
            start = starts[key]
            owner = start.owner if head else key[1]
            text = ",".join(held) + ("" if ended else ",")
            out.append({"file": key[0], "owner": owner, "seq": seq, "block": key[1], "whole": ended and not head, "text": text})
            held, seq, head = [], seq + 1, False

        for file, block, piece in _keyed(batches):
            if key != (file, block):
                if key is not None and held:
                    close(depth == 0 and not inside)
                key, held, seq = (file, block), [], 0
                if key not in starts:
                    raise ValueError("the file's blocks have changed")
                start = starts[key]
                inside, depth, first = start.inside, start.depth, start.depth == 0
                head = not first and not (start.owner == block)
                if first:
                    piece = piece.lstrip("﻿ \t\r\n")
            else:
                first = False
            odd, outside, within = piece_change(piece)
            depth += within if inside else outside
            inside ^= odd
            if first:
                piece = piece[1:]
            if not inside and depth == 0:
                piece = piece.rstrip()[:-1]
            held.append(piece)
            if not inside and depth <= 1:
                close(True)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if key is not None and held:
            close(depth == 0 and not inside)
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def split_json(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (`[` or `{`), place (struct, in the order of the file), text of every entry of JSON lists and objects.

    An entry of a list is its JSON; one of an object is `"name": value`. A file that is neither, or ends too early, raises.
    Only a few numbers a block go to the driver.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts = starts_of(pieces.mapInArrow(_summaries, SUMMARY).collect())
    kinds = {file: s.kind for (file, _), s in starts.items()}
    parts = pieces.mapInArrow(_parts(starts), PART)
    whole = parts.where("whole").select("file", F.col("owner").alias("block"), "seq", "text")
    open_ = parts.where("not whole").groupBy("file", "owner").agg(F.lit(_LAST).alias("seq"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    rows = whole.unionByName(open_.withColumnRenamed("owner", "block")).where(F.trim("text") != "")
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("file")] if kinds else F.lit(None).cast("string")
    return rows.select("file", kind.alias("kind"), F.struct("file", "block", "seq").alias("place"), "text")
