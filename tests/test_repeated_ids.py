"""Entries that share an id, as the ids of the model's records do beyond a million."""

from collections import Counter

import duckdb
import pytest

from lexweave.plans.queries import ORACLES, QUERIES


def rows(part):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in part)


@pytest.mark.parametrize("name", ["q_failures", "q_token_summary"])
def test_against_sql(spark, tmp_path, name):
    """7 becomes 1000007, which is an id of its own; outputs of equal and of other lengths meet."""
    con = duckdb.connect()
    con.sql(f"copy (select p.* replace ((p_partkey + i * 1000000)::bigint as p_partkey, case when i = 1 and p_partkey % 2 = 0 then p_name || ' again so' else p_name end as p_name) from range(2) r(i), '/root/testdata/sf0.001/part.parquet' p) to '{tmp_path}/part.parquet' (format parquet)")
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = rows(con.sql(ORACLES[name]).fetchall())
    assert rows(map(tuple, got.collect())) == want
