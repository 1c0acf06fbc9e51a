"""Writers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compare import exact_match_summary, presence_summary
from .xlsx import workbook


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of doubles and floats as null, in arrays, structs and the values of maps too."""

    def fixed(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: fixed(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: fixed(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fixed(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[fixed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line with null fields kept."""
    nan_to_null(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header; arrays and structs as JSON."""
    _flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One folder a sheet, named by at most 31 letters as spreadsheets want it."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{re.sub(r'[^A-Za-z0-9_ -]', '_', name)[:31]}")


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """An XLSX workbook at a path of any file system; arrays and structs as JSON, rows a partition at a time."""
    for df in sheets.values():
        spark = df.sparkSession
    with tempfile.TemporaryDirectory() as folder:
        local = f"{folder}/book.xlsx"
        workbook(local, {name: (df.columns, _flat(nan_to_null(df)).toLocalIterator()) for name, df in sheets.items()})
        jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)


def write_presence_summary(merged: DataFrame, path: str) -> None:
    write_csv(presence_summary(merged), path)


def write_exact_match_summary(merged: DataFrame, path: str) -> None:
    write_csv(exact_match_summary(merged), path)
