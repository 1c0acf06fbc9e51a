"""Numbers of rows in a total order without one task that sees all."""

import re

from pyspark.sql import functions as F

from lexweave.operators import cascade, extract
from lexweave.operators.numbering import number_rows, slice_rows


def test_numbers_and_ties(spark):
    """A third of the rows ties; nulls come first; the extra columns stay, whatever their names."""
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else (i * 37) % 1000, f"t{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, text string, number_of int").repartition(5)
    got = number_rows(df, "key", "text", name="n", start=0, ranges=6).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(3000))


def test_equal_rows_are_parted(spark):
    same = spark.range(0, 4000, 1, 4).select(F.lit("x").alias("key"), F.lit("y").alias("value"))
    out = number_rows(same, "key", ranges=8)
    assert sorted(r["number"] for r in out.collect()) == list(range(1, 4001))
    per_range = out.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in per_range) < 2000


def test_empty(spark):
    none = spark.createDataFrame([], "key int")
    assert number_rows(none, "key").count() == 0 and number_rows(none, "key").columns == ["key", "number"]
    assert slice_rows(none, "key", skip=3).count() == 0


def test_no_single_task(spark):
    rows = spark.range(100).select((F.col("id") * 3 + 5).alias("para_id"), F.lit("gaffer n. a boss.").alias("text"))
    records = cascade.parse(rows, renumber=True)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert sorted(r["para_id"] for r in records.collect()) == list(range(1, 101))
    assert {r["id"] for r in records.select("id").collect()} == {f"hde_{i:05d}" for i in range(1, 101)}


def test_slices_of_any_length(spark, monkeypatch):
    entries = spark.createDataFrame([(f"e{i}", str(i), i) for i in range(300)], "entry_id string, entry_text string, place int").repartition(4)
    done = spark.createDataFrame([(f"e{i}",) for i in range(0, 300, 2)], "entry_id string")
    short = [r["entry_id"] for r in extract.next_batch(entries, done, 10, 20, "place").collect()]
    monkeypatch.setattr(extract, "HEAD", 5)
    batch = extract.next_batch(entries, done, 10, 20, "place")
    assert [r["entry_id"] for r in batch.collect()] == short == [f"e{i}" for i in range(21, 61, 2)]
    rest = extract.next_batch(entries, done, 140, None, "place")
    assert [r["entry_id"] for r in rest.collect()] == [f"e{i}" for i in range(281, 300, 2)]
    for df in (batch, rest):
        assert not re.search("SinglePartition|GlobalLimit|TakeOrdered", df._jdf.queryExecution().executedPlan().toString())


def test_structs_by_field(spark):
    """Rows keyed by structs with nulls are numbered as by the structs themselves, sorted by their fields, and only what is asked for is kept."""
    rows = [(None if i % 13 == 0 else (None if i % 7 == 0 else i * 37 % 50, None if i % 5 == 0 else f"k{i % 11}"), f"t{i:03d}") for i in range(600)]
    df = spark.createDataFrame(rows, "key struct<`a.b`: int, c: string>, text string").repartition(5)
    want = [r["text"] for r in df.orderBy("key", "text").collect()]
    got = number_rows(df, "key", "text", ranges=4, keep=["text"])
    assert got.columns == ["text", "number"] and [r["text"] for r in sorted(got.collect(), key=lambda r: r["number"])] == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
