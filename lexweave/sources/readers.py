"""Readers of paragraphs, entries, records and small driver-side files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_text, strip
from ..schemas import ENTRY
from .docx import read_docx
from .json_split import split_json


def split_paragraphs(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines of each text with their place counted from 1 over all lines; blank ones are left out."""
    rows = df.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = rows.select(*keep, (F.col("pos") + 1).alias("para_id"), strip("line").alias("text"))
    return rows.where(F.col("text") != "").withColumn("text_hash", hash_text("text"))


def text_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of whole text files."""
    return split_paragraphs(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of DOCX files: para_id, text, text_hash, and the path of the file, within which ids count."""
    return clean_paragraphs(read_docx(spark, path))


def clean_paragraphs(rows: DataFrame) -> DataFrame:
    """Stripped texts that are not blank, of (path, para_id, text)."""
    return rows.select("para_id", strip("text").alias("text"), "path").where(F.col("text") != "").select("para_id", "text", hash_text("text").alias("text_hash"), "path")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a broken line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_entries(spark: SparkSession, path: str, with_place: bool = False) -> DataFrame:
    """entry_id, entry_text from a JSON list, a JSON object from id to text, or JSON lines, all read in blocks.

    `with_place` adds the struct `place`, by which the entries stand in the order of the input.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind in (".jsonl", ".ndjson"):
        lines = read_jsonl(spark, path, ENTRY)
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
        return lines.select("*", place.alias("place")) if with_place else lines
    if kind != ".json":
        raise ValueError(f"unknown kind of input: {kind or path}")
    cut = split_json(spark, path)
    strict = {"mode": "FAILFAST"}
    listed = F.from_json("text", f"struct<{ENTRY.replace(' string', ': string')}>", strict)
    rows = cut.where("kind = '['").select(listed.alias("e"), "place").select("e.*", "place")
    named = F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>", strict))
    rows = rows.unionByName(cut.where("kind = '{'").select(named.alias("entry_id", "entry_text"), "place"))
    return rows if with_place else rows.drop("place")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in earlier output; broken lines are ignored, no output gives no id."""
    try:
        rows = spark.read.schema("entry_id string").option("mode", "DROPMALFORMED").json(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "entry_id string")
    return rows.where(F.col("entry_id").isNotNull()).distinct()


def rename_on_load(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(names or {"paragraph_id": "entry_id", "text": "entry_text"})


def load_prompt(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read().rstrip()


def load_map(path: str | None) -> dict[str, str]:
    """A JSON object; empty where there is no file."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)
