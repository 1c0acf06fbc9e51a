"""Costly work a row is dealt over all tasks, whatever few files its rows come from; white space as Python has it."""

import json
import os
import unicodedata

from pyspark.sql import functions as F

from lexweave.functions import arrays as A
from lexweave.functions import text as T
from lexweave.operators import cascade, normalize
from lexweave.plans import queries, round_trips

SF = "/root/testdata/sf0.01"


def rows_a_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def even(df, n=2000):
    sizes = rows_a_task(df)
    return sum(sizes) == n and len(sizes) >= 4 and max(sizes) <= n / 4 + 10


def test_one_file_is_many_tasks(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert len(rows_a_task(part)) == 1 and part.count() == 2000
    texts = part.select(F.col("p_partkey").alias("para_id"), F.concat("p_name", F.lit(" n. a thing")).alias("text"))
    assert even(cascade.parse(texts))
    assert even(cascade.pattern_evaluations(texts))
    assert even(queries.QUERIES["q_list_clean"](spark, SF))
    assert even(normalize.normalize_rule(queries._rule_records(spark, SF)))
    flat = normalize.flatten_model(queries._model_records(spark, SF))
    assert even(normalize.normalize_model(flat), flat.count())
    asked = queries._replies(spark, SF)
    assert even(asked, asked.count())


def test_lists_of_entries_grow_in_number(spark, tmp_path):
    """1,600 entries of 10 KB that don't compress: more than three files, each a whole list."""
    rows = spark.range(0, 1600, 1, 1).select(F.col("id").cast("string").alias("entry_id"), F.expr("array_join(transform(sequence(1, 160), i -> sha2(concat(id, '-', i), 256)), '')").alias("entry_text"))
    path = f"{tmp_path}/list"
    round_trips._json_files(rows, path, "[")
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    lists = [json.load(open(f"{path}/{f}")) for f in files]
    assert len(files) > 3 and sorted(int(e["entry_id"]) for entries in lists for e in entries) == list(range(1600))
    assert max(map(len, lists)) <= 1600 / 3


def test_model_is_asked_once(spark, tmp_path):
    """The two outputs of a batch are written from one round of requests."""
    spark.read.parquet(f"{SF}/customer.parquet").limit(60).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    calls, stub = f"{tmp_path}/calls", round_trips._stub

    def counted():
        ask = stub()

        def run(system, user):
            with open(calls, "a") as f:
                f.write("x\n")
            return ask(system, user)

        return run

    round_trips._stub = counted
    try:
        assert round_trips.append_log(spark, str(tmp_path)).count() == 60
    finally:
        round_trips._stub = stub
    assert len(open(calls).readlines()) == 60


def test_white_space(spark):
    """Every character of the first plane at either end and between letters, with the regular expression as its measure."""
    points = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF]
    df = spark.createDataFrame([(f"{c}a{c}b {c}  c{c}",) for c in points] + [("",), (None,), (" \t ",), ("a  b",)], "t string")
    stripped = F.regexp_replace("t", rf"(?U)^{T.WS}+|{T.WS}+\z", "")
    bad = df.where(~T.strip("t").eqNullSafe(stripped) | ~T.collapse("t").eqNullSafe(F.regexp_replace(stripped, rf"(?U){T.WS}+", " ")))
    assert [r["t"] for r in bad.collect()] == []


def test_odd_items(spark):
    """Arrays with and without items that NFKC changes, nulls among them."""
    rows = [(["ﬁ", None, "é"],), ([None],), ([],), (None,), (["plain", "é"],), (["²", "x"],), ([None, "ﬀ"],)]
    got = spark.createDataFrame(rows, "a array<string>").coalesce(1).select(T.normalize_items("a").alias("n"), T.fold_items("a").alias("f"), A.clean_list("a").alias("c")).collect()
    changed = lambda f: [None if a is None else [None if x is None else f(x) for x in a] for (a,) in rows]
    assert [r["n"] for r in got] == changed(lambda x: unicodedata.normalize("NFKC", x))
    assert [r["f"] for r in got] == changed(lambda x: unicodedata.normalize("NFKC", x).casefold())
    assert [r["c"] for r in got] == [["fi", "é"], [], [], [], ["plain", "é"], ["2", "x"], ["ff"]]
