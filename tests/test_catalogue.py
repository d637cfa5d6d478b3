"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from framewright.plans import catalogue, engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(t):
    names = sorted(t.column_names)
    return names, sorted((str([plain(x) for x in r]) for r in zip(*[t.column(n).to_pylist() for n in names], strict=True)))


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_equals_sql(name, spark, duck):
    got = rows(catalogue.QUERIES[name](spark, SF).toArrow())
    if name in catalogue.ORACLES:
        assert got == rows(duck.sql(catalogue.ORACLES[name]).to_arrow_table())
    else:
        assert got[1]


def test_scan_reads_two_columns_and_pushes_the_filter(spark):
    df = catalogue.table(spark, SF, "orders").where("o_totalprice > 1000").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and "GreaterThan(o_totalprice,1000.0)" in plan


def written(path, **tables):
    """Tables of the folder and DuckDB's SQL over them."""
    c = duckdb.connect()
    for name, text in tables.items():
        c.execute(f"COPY ({text}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return c


def test_lateral_limit_is_ordered_within_each_customer(spark, tmp_path):
    """The order has to stand in the window: one that a sort before the shuffle leaves is lost where blocks arrive in another order."""
    c = written(
        tmp_path, customer="SELECT * FROM (VALUES (1::BIGINT), (1), (2), (3), (4), (NULL)) t(c_custkey)",
        orders="SELECT * FROM (VALUES (NULL::BIGINT, 1::BIGINT, 5::DOUBLE), (12, 1, 5), (11, 1, 5), (13, 1, 4), (20, 2, NULL), (21, 2, 1), (30, 3, NULL), (31, 3, NULL), (50, NULL, 9)) t(o_orderkey, o_custkey, o_totalprice)",
    )
    df = catalogue.QUERIES["join_lateral"](spark, str(tmp_path))
    assert rows(df.toArrow()) == rows(c.sql(catalogue.ORACLES["join_lateral"]).to_arrow_table())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "row_number() windowspecdefinition(o_custkey" in plan and "o_totalprice" in plan.split("row_number() windowspecdefinition(", 1)[1].split("specifiedwindowframe")[0]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ("SELECT NULL::BIGINT AS l_orderkey, 25::DOUBLE AS l_quantity UNION ALL SELECT 7, 25 FROM range(3)", (True, True)), ("SELECT NULL::BIGINT AS l_orderkey, 25::DOUBLE AS l_quantity FROM range(3)", (True, True)),
        ("SELECT range AS l_orderkey, 60::DOUBLE AS l_quantity FROM range(300)", (True, False)), ("SELECT 1::BIGINT AS l_orderkey, 25::DOUBLE AS l_quantity WHERE false", (True, None)),
    ],
)
def test_approximate_aggregates_keep_no_sketch_for_each_key(lines, want, spark, tmp_path):
    """Beside the exact count of keys, sketches are of the whole table: one for each key and quantiles for each key take a table's memory many times."""
    written(tmp_path, lineitem=lines)
    df = catalogue.QUERIES["agg_approx"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [want]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct(l_orderkey" in plan and "percentile_approx(l_quantity" in plan and "ObjectHashAggregate(keys=[l_orderkey" not in plan
