"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts per step inside an Arrow batch, so that one step stays small.
STEP_ROWS = 256
_WRITTEN: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        path = getattr(scratch_dir, "own", None) or tempfile.mkdtemp(prefix="lexweave-")
        scratch_dir.own = path
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage and fixes its rows."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lexweave_path = path
    _WRITTEN.add(path)
    return out


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, for files that are not one table."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


@contextlib.contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]):
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder of the shared store, whose parent is made where it is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(new).getParent())
    if not store.rename(path(old), path(new)):
        raise OSError(f"can't move {old} to {new}")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Delete what written() stored, once nothing reads it any more."""
    path = getattr(df, "lexweave_path", None)
    if path:
        _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all that written() stored in this process; results that were not stored elsewhere can't be read afterwards."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def steps(batches: Iterator[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into smaller ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def lower_ascii(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(docs: DataFrame, run, schema: str, columns: list, carry: bool) -> DataFrame:
    """mapInArrow over `columns`; with `carry` each input row comes along whole as the struct `row`.

    `run` yields a batch for each batch of steps() with as many rows, in order; a stage that
    filters or edits documents then needs no join to get back to them.
    """
    kind = T.StructType.fromDDL(schema)
    if not carry:
        return docs.select(*columns).mapInArrow(run, kind)
    rows = docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column("row")], names=[*out.schema.names, "row"])

    return rows.mapInArrow(along, T.StructType([*kind.fields, T.StructField("row", rows.schema["row"].dataType)]))
