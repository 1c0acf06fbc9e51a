"""Stored runs are compared bucket by bucket."""

import pytest

from lexweave.operators import runs
from lexweave.operators.snapshots import Snapshots

FIELDS = ["headword", "examples"]
KIND = "para_id int, source_text string, headword string, examples array<string>"


def test_compared_without_a_shuffle(spark, tmp_path):
    old = spark.createDataFrame([(i, f"s{i}", f"h{i % 7}", [str(i)]) for i in range(300)], KIND)
    new = spark.createDataFrame([(i, f"s{i % 250}", f"h{i % 5}", None if i % 9 == 0 else [str(i)]) for i in range(100, 400)], KIND)
    store = Snapshots(spark, f"{tmp_path}/runs", buckets=4)
    store.save(1, runs.build_parsed(old, FIELDS))
    store.save(2, runs.build_parsed(new, FIELDS))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Snapshots(spark, f"{tmp_path}/runs", buckets=99).compare(1, 2, FIELDS)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = runs.compare_runs(old, new, compare=FIELDS)
        shown = lambda df: sorted(map(tuple, df.select("para_id", "change_status", "changed_columns", "source_changed", "parse_changed").collect()))
        assert shown(got) == shown(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_refused(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/runs", buckets=2)
    rows = runs.build_parsed(spark.createDataFrame([(1, "s", "h", ["e"])], KIND), FIELDS)
    store.save(1, rows)
    with pytest.raises(ValueError):
        store.save(1, rows)
    with pytest.raises(Exception, match="without para_id"):
        store.save(2, runs.build_parsed(spark.createDataFrame([(None, "s", "h", ["e"])], KIND), FIELDS))
    assert store.load(1).count() == 1
