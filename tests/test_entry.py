import duckdb
import pytest

import __spark_entry__ as e
from spark_rca.catalog import basic
from spark_rca.catalog.jobs import JOBS

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events".split()


def test_registry():
    q, s = e.queries(), e.oracle_sql()
    assert set(basic.CATALOG) | set(JOBS) <= set(q) and set(s) <= set(q)


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p3_fill_zeros", "w8_islands_over", "e3_rank_score", "o1_anomaly_start"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    want = con.sql(e.oracle_sql()[name])
    got = e.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    norm = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert norm(got.select(cols).collect()) == norm(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
