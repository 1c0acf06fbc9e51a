"""Token-id output: concatenated ids with Elias-Fano document boundaries (operator 9)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, texts_of, written
from .elias_fano import EliasFano
from .tokens import encoder, read_spec

MAGIC = b"LXTK2\0"
#: A file is closed when it holds so many ids.
FILE_IDS = 1 << 20

FILE_SCHEMA = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ids_before", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file: header, document ids, boundaries, then the token ids side by side.

    Token ids take 2 bytes while all are below 65,536 and 4 bytes otherwise; document i spans
    boundary i-1 (0 for the first) up to boundary i. Document ids ascend, null ones first, so what they exceed the
    least one by is encoded like the boundaries.
    """
    nulls = sum(x is None for x in doc_ids)
    known = [int(x) for x in doc_ids[nulls:]]  # a null after an id raises
    if any(a > b for a, b in zip(known, known[1:], strict=False)):
        raise ValueError("document ids must ascend")
    least = known[0] if known else 0
    names = EliasFano.encode(np.array([x - least for x in known], dtype=np.uint64)).to_bytes()
    ends = EliasFano.encode(np.cumsum([len(x) for x in ids], dtype=np.uint64)).to_bytes()
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    width = 2 if len(flat) == 0 or int(flat.max()) < 1 << 16 else 4
    return b"".join([MAGIC, struct.pack("<BQQQq", width, len(ids), len(flat), nulls, least), names, ends, flat.astype(f"<u{width}").tobytes()])


class TokenFile:
    """A packed file; ids(i) finds document i by two selects."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)
        width, n, total, nulls, least = struct.unpack_from("<BQQQq", raw, at)
        at += struct.calcsize("<BQQQq")
        names, used = EliasFano.from_bytes(raw[at:])
        at += used
        self.doc_ids = [None] * nulls + [int(x) + least for x in names.values()]
        self.ends, used = EliasFano.from_bytes(raw[at:])
        at += used
        self.flat = np.frombuffer(raw, f"<u{width}", total, at)
        if len(self.doc_ids) != n:
            raise ValueError("not a token file")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append `end_id`, and store the files in ascending order of `id_col`.

    The result has one row per file: part and seq give the order, ids_before the ids of the
    same part before it, payload the file's bytes. The rows are stored in the shared folder,
    so any file system that Spark can reach will do. Documents are dealt by range of their
    id; only one file's ids are held by a task at a time. Null text counts as empty, a null
    id comes first, rows with the same id follow each other in the order of their texts, and
    an empty table gives no file.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = dealt.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("ids_before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            total = sum(map(len, held))
            row = [[part], [seq], [before], [len(held)], [total], [pack_file(names, held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        count = 0
        for batch in steps(batches, 64):
            ends = np.array([end_id], dtype=np.uint32)
            for name, own in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch, "text")), strict=True):
                names.append(name)
                held.append(np.concatenate([own, ends]))
                count += len(own) + 1
                if count >= FILE_IDS:
                    yield close()
                    names, held, seq, before, count = [], [], seq + 1, before + count, 0
        if held:
            yield close()

    return written(dealt.mapInArrow(pack, FILE_SCHEMA), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. The base of each part is a sum over
    the parts before it; there are as many parts as write tasks, which bounds what is broadcast.
    """
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    rows = sorted((r["part"], r["n"]) for r in sums.collect())
    bases, total = [], 0
    for part, n in rows:
        bases.append((part, total))
        total += n
    base = files.sparkSession.createDataFrame(bases, "part long, base long")
    out = T.StructType([T.StructField("part", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            row = batch.to_pylist()[0]
            file = TokenFile(row["payload"])
            ends = file.ends.values().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            flat = file.flat.astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            n = len(file)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int64()), pa.array(file.doc_ids, pa.int64()), pa.array(starts + row["ids_before"]), pa.array(ends - starts), pa.array(sums, pa.int64())],
                names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
            )

    got = files.select("part", "ids_before", "payload").mapInArrow(unpack, out)
    return got.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


