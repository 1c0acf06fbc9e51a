"""Numbers of rows in a total order, and slices by them, at any size.

Rows are sorted by range, each range numbers its own, and the numbers of the ranges before are added: no row meets all others
in one task. Sorted ranges are written once to the shared folder, for their bounds come from a sample and would not be the
same when computed again.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import written

_PLACE, _TIE, _LOCAL = "_place", "_tie", (1 << 33) - 1


def number_rows(df: DataFrame, *order: Column | str, name: str = "number", start: int = 1, ranges: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """`df` with a LONG column that counts its rows from `start` in the given order; ties are numbered as they come.

    `ranges` is the number of sorted ranges, by default that of shuffle partitions. Only one count a range goes to the
    driver. Rows that tie are parted too, by where they lie, so many equal rows don't meet in one range. Null values
    come first, an empty frame stays empty. Structs are compared field by field, which sorts on their first field's bytes
    and not by a call a pair. `keep` names the columns that are stored and returned, by default all.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[x for c in order for x in _flat(df, c)], F.col(_TIE)]
    kept = df.columns if keep is None else keep
    ranged = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).select(*[F.col(f"`{c}`") for c in kept])
    # The id that Spark gives each row holds the partition above and the place in it below.
    placed = written(ranged.withColumn(_PLACE, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(_PLACE, 33).cast("int")
    # Counts go back as a literal: a frame made from them would start Python workers.
    counts = dict(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    parts = sorted(counts)
    before = dict(zip(parts, accumulate([counts[p] for p in parts], initial=0), strict=False))
    offsets = F.lit([before.get(p, 0) for p in range(max(parts, default=0) + 1)]).cast("array<long>")
    return placed.select(*[F.col(f"`{c}`") for c in kept], (F.get(offsets, part) + F.col(_PLACE).bitwiseAND(F.lit(_LOCAL)) + start).alias(name))


def _flat(df: DataFrame, c: Column | str) -> list[Column]:
    """Keys that sort as the column does; a null struct comes before one of nulls."""
    if not (isinstance(c, str) and c in df.columns and isinstance(df.schema[c].dataType, StructType)):
        return [F.col(c) if isinstance(c, str) else c]
    whole = F.col(f"`{c}`")
    return [*[whole[field.name] for field in df.schema[c].dataType.fields], whole.isNotNull()]


def slice_rows(df: DataFrame, *order: Column | str, skip: int = 0, most: int | None = None) -> DataFrame:
    """The rows after the first `skip`, `most` of them or all, in no particular order."""
    name = "_rank"
    rank = F.col(name)
    keep = rank > skip if most is None else rank.between(skip + 1, skip + most)
    return number_rows(df, *order, name=name).where(keep).drop(name)
