import os

import duckdb
import pandas as pd
import pytest

from rowloom import queries
from rowloom.plans.gate import pushed_filters, read_columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, folder, duck, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10
    assert [r.o_totalprice for r in rows] == sorted((r.o_totalprice for r in rows), reverse=True)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, folder):
    run = lambda name: queries.QUERIES[name](spark, folder)
    assert any("EqualTo(c_mktsegment,BUILDING)" in x for x in pushed_filters(run("eq_lookup")))
    assert any("In(o_orderkey" in x for x in pushed_filters(run("point_get_in_sorted")))
    assert any("GreaterThanOrEqual(o_totalprice,100000.0)" in x for x in pushed_filters(run("range_closed")))
    assert any("StringStartsWith(p_type,S)" in x for x in pushed_filters(run("prefix_like")))
    assert "TakeOrderedAndProject" in plan(run("topk_desc"))
    assert "TakeOrderedAndProject" in plan(run("keyset_page"))
    assert read_columns(run("zero_width_count")) == [""]
    assert "o_custkey" not in read_columns(run("range_open"))[0]
    assert "CartesianProduct" not in plan(run("join_theta"))
