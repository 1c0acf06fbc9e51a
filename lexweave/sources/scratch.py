"""Tables that fix rows on the way, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lexweave-"))
        path = _own[0]
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its rows are fixed and its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
