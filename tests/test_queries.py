"""Every catalog query against its SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from hydroledger.operators import ordered
from hydroledger.plans import catalog, staging

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def in_order(table):
    return sorted(table, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(entry_points.oracle_sql()) >= set(NAMES)
    assert set(entry_points.queries()) >= set(NAMES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = in_order(tuple(r[c] for c in columns) for r in df.collect())
    want = sql.sql(entry_points.oracle_sql()[name])
    assert sorted(want.columns) == columns
    want = in_order(tuple(r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert got == want
    assert got


@pytest.fixture
def plans(spark, monkeypatch):
    """Physical plans of a query: its written steps and its result."""

    def collect(name):
        seen = []

        def text(df):
            return df._jdf.queryExecution().executedPlan().toString()

        def watched(df):
            seen.append(text(df))
            return staging.stage(df)

        monkeypatch.setattr(catalog, "stage", watched)
        monkeypatch.setattr(ordered, "stage", watched)
        seen.append(text(entry_points.queries()[name](spark, SF)))
        return seen

    return collect


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(plans, settings, name):
    # As on large tables: no side is small enough to broadcast by size.
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    for plan in plans(name):
        for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan
        for line in plan.splitlines():
            if " Window [" in line and "origin_id" in line:
                assert "_group" in line and "_part" in line  # never one task per group


def test_filters_and_columns_reach_the_scan(plans):
    plan = "\n".join(plans("tail_origins_crop"))
    scan = next(x for x in plan.splitlines() if "orders.parquet" in x)
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01" in scan
    assert "LessThan(o_orderdate,1" in scan
    assert "o_totalprice" not in scan and "o_orderpriority" not in scan
    lines = next(x for x in plan.splitlines() if "lineitem.parquet" in x)
    assert "l_discount" not in lines and "l_partkey" not in lines


def test_hot_supplier_shrinks_before_places_are_joined(plans, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    first = plans("tail_origins_crop")[0].splitlines()
    join = next(i for i, x in enumerate(first) if "[s_suppkey" in x and "Join" in x)
    below = [x for x in first[join:] if "HashAggregate" in x]
    assert any("partial_sum" in x and "l_suppkey" in x for x in below)


def test_crop_and_herd_add_up(spark):
    """Shares and residuals are consistent across queries."""
    from pyspark.sql import functions as F

    run = entry_points.queries()
    left = run["state_domestic_residual"](spark, SF).agg(F.sum("volume"), F.sum("produced")).first()
    out = run["state_exports"](spark, SF).agg(F.sum("volume_out")).first()
    assert left[0] + out[0] == pytest.approx(left[1], abs=1e-6)
    last = run["tail_layer_crop"](spark, SF).groupBy("year", "bloc").agg(F.max("perc").alias("m"))
    assert all(r.m <= 1.0 for r in last.collect())
    panel = run["basin_panel_bulk"](spark, SF).groupBy("year", "bloc").agg(F.count_distinct("basin").alias("n"))
    domain = run["missing_basins_bulk"](spark, SF).count()
    assert domain > 0
    assert len({r.n for r in panel.collect()}) == 1


ONE_PRODUCT = (
    "crop_bloc_footprint", "crop_scarcity_bins", "crop_water_bins", "crop_production_summary",
    "hotspot_origins_crop", "median_savings_crop", "tail_layer_crop", "tail_origins_crop",
)


@pytest.mark.parametrize("name", ONE_PRODUCT)
def test_one_product_reaches_the_scan(plans, name):
    scans = [x for p in plans(name) for x in p.splitlines() if "lineitem.parquet" in x]
    assert scans
    assert all("EqualTo(l_linestatus,O)" in x for x in scans)


def test_lines_that_match_no_benchmark_end_in_the_scan(plans):
    last = plans("hotspot_origins_crop")[-1]
    assert "l_suppkey" in last and "% 10) = 9)" in last


def test_water_series_come_in_published_order(spark):
    ranks = [r.type_rank for r in catalog.QUERIES["water_long"](spark, SF).collect()]
    assert ranks == sorted(ranks)


@pytest.mark.parametrize("name", ["crop_bloc_footprint", "herd_bloc_footprint", "hotspot_clearing_share"])
def test_reports_come_sorted(spark, name):
    got = [(r["product"], r.year, r.bloc) for r in catalog.QUERIES[name](spark, SF).collect()]
    if name == "hotspot_clearing_share":
        assert got == sorted(got, key=lambda r: (r[0] != "Soy", r[1], r[2]))
    else:
        assert got == sorted(got, key=lambda r: (-int(r[1]), r[2]))
