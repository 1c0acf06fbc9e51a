"""Training-data queries against their SQL in DuckDB, on the given tables and on odd rows."""

import duckdb
import pytest

from lexweave.llm import decontaminate, neighbours, repeats
from lexweave.llm.oracles import ORACLES
from lexweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "".join(f"word{i} " for i in range(90))
TEXTS = [(1, None), (2, ""), (3, LONG), (4, f"é {LONG[:450]} end"), (5, LONG[100:]), (6, "a b c"), (7, "x" * 900), (None, "A-B c ß d"), (3, LONG)]
ITEMS = [(1, "a b c"), (2, None), (3, ""), (10, LONG[:120]), (None, "ß d"), (1, "c ß d")]
VECTORS = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (21, [1.0, 0.5]), (40, [0.0, 0.0]), (60, None), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [1.0]), (None, [1.0, 1.0]), (140, [-0.25, 3.0])]


def same(df, sql, con):
    want = con.sql(sql)
    got = [tuple(r) for r in df.select(*want.columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    same(QUERIES[name](spark, SF), ORACLES[name], con)


def test_odd_rows(spark):
    con = duckdb.connect()
    for table, columns, rows in (("documents", "doc_id bigint, text varchar", TEXTS), ("benchmark", "item_id bigint, text varchar", ITEMS), ("embeddings", "vec_id bigint, embedding float[]", VECTORS)):
        con.sql(f"create table {table} ({columns})")
        con.executemany(f"insert into {table} values (?, ?)", rows)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(decontaminate.find_contamination(docs, items), ORACLES["op6_decontaminate"], con)
    same(repeats.remove_repeats(docs), ORACLES["op4_repeats"], con)
    same(neighbours.nearest(spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")), ORACLES["op3_neighbours"], con)
