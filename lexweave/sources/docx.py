"""Paragraphs of DOCX files from any store that Spark reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraph_texts(data) -> Iterator[str]:
    """Text of each paragraph of the body, in order, blank ones too; tables are not body paragraphs."""
    with zipfile.ZipFile(data) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for p in body.findall(f"{_W}p") if body is not None else ():
        parts = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        yield "".join(parts)


def docx_rows(files: DataFrame) -> DataFrame:
    """path, para_id (from 1, blank paragraphs counted), text of every file of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = list(paragraph_texts(io.BytesIO(batch.column("content")[i].as_py())))
                columns = [pa.array([batch.column("path")[i].as_py()] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "para_id", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, para_id int, text string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """docx_rows() of a file, or of the .docx files of a folder or pattern."""
    reader = spark.read.format("binaryFile")
    return docx_rows((reader if path.endswith(".docx") else reader.option("pathGlobFilter", "*.docx")).load(path))
