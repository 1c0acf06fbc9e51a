"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from lexweave.plans import round_trips as round_trips
from lexweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert len(got) == len(want)
    assert rounded(got) == rounded(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 11


def test_ordered_matches_take_whole_turns(spark, tmp_path):
    reply = " ".join(f"filler{i}" for i in range(40)) + " alpha beta gamma"
    rows = [(1, 0, "user", "alpha beta gamma"), (1, 1, "assistant", reply), (1, 2, "user", "beta alpha"), (1, 3, "assistant", "alpha beta"), (2, 0, "user", "no reply")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {name: {(r["conv_id"], r["turn"]): (r["matched"], r["precision"], r["recall"]) for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("q_ordered_out", "q_ordered_src")}
    assert got["q_ordered_out"] == {(1, 0): (3, round(3 / 43, 6), 1.0), (1, 2): (1, 0.5, 0.5)}
    assert got["q_ordered_src"] == {(1, 0): (3, round(3 / 43, 6), 1.0), (1, 2): (1, 0.5, 0.5)}
