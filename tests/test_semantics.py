"""One test per rule where the accounting tables differ from Spark's defaults."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hydroledger.functions import (
    ascending,
    descending,
    distinct_with_missing,
    exact_mean,
    exact_sum,
    is_member,
    missing_or_equal,
    na_concat,
    na_if_else,
    na_if_else_sql,
    nz,
    nz_sum,
    percent,
    r_round,
    ratio,
    signif,
    strict_exact_sum,
    strict_sum,
)
from hydroledger.functions import bins as published
from hydroledger.functions.bins import Bins


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def one(df, expr):
    return df.agg(expr.alias("y")).first().y


def test_sums_do_not_depend_on_layout(spark):
    values = [0.1 * i for i in range(2000)] + [1e9 + 0.01, -1e9]
    df = frame(spark, values)
    seen = {one(df.repartition(n), exact_sum("x")) for n in (1, 3, 7)}
    assert {float(s) for s in seen} == {sum(range(2000)) / 10 + 0.01} and len(seen) == 1


def test_small_values_add_up(spark):
    df = spark.range(1000).select(F.lit(4e-7).alias("x"))
    assert one(df, nz_sum("x")) == 4e-4
    with pytest.raises(Exception, match="too small"):
        frame(spark, [1e-20]).agg(exact_sum("x")).collect()


@pytest.mark.parametrize("places", [None, 4])
def test_sums_of_sums_are_sums_of_rows(spark, places):
    df = spark.range(400).select((F.col("id") % 7).alias("k"), F.lit(2.5e13).alias("x"))
    df = df.union(spark.createDataFrame([(1, 0.01), (2, 0.0003)], "k long, x double"))
    parts = df.groupBy("k").agg(exact_sum("x", places).alias("x"))
    assert one(parts, exact_sum("x")) == one(df, exact_sum("x")) == Decimal("1e16") + Decimal("0.0103")
    assert one(parts, nz_sum("x")) == 1e16


def test_declared_places_are_checked(spark):
    assert one(frame(spark, [0.1234, 7.0, None]), exact_sum("x", 4)) == Decimal("7.1234")
    with pytest.raises(Exception, match="more than 4 decimal places"):
        frame(spark, [0.12345]).agg(exact_sum("x", 4)).collect()


@pytest.mark.parametrize("value", [4e-7, 0.00004, -0.00005, 1e-300, 1234.56789, 1e9 + 0.00005])
def test_no_declared_value_vanishes(spark, value):
    df = spark.range(1000).select(F.lit(value).alias("x"))
    with pytest.raises(Exception, match="more than 4 decimal places"):
        df.agg(exact_sum("x", 4)).collect()
    with pytest.raises(Exception, match="more than 4 decimal places"):
        df.agg(strict_exact_sum("CASE WHEN x IS NOT NULL THEN x ELSE 0D END", 4)).collect()


@pytest.mark.parametrize("value", [4e-19, 1.234567894e-10, 3.0000001e-17])
@pytest.mark.parametrize("x", ["x", "x * 1D", "CASE WHEN 'a' = 'a' THEN x END"])
def test_no_value_or_expression_vanishes(spark, value, x):
    df = spark.range(10).select(F.lit(value).alias("x"), F.lit(2).alias("n"))
    for total in (exact_sum(x), nz_sum(x), nz_sum(x, "n"), strict_sum(x), exact_mean(x)):
        with pytest.raises(Exception, match="too small"):
            df.agg(total).collect()


@pytest.mark.parametrize("value", [4e-13, 3e-17, 1e-18, 5.5, -7.25e-10, 123456789012.125])
def test_small_and_large_values_are_counted(spark, value):
    df = spark.range(250).select(F.lit(value).alias("x"), F.lit(4).alias("n"))
    assert one(df, nz_sum("x", "n")) == float(Decimal(repr(value)) * 1000)
    assert one(df, nz_sum("x")) == float(Decimal(repr(value)) * 250)


def test_declared_values_at_both_ends(spark):
    df = frame(spark, [0.0001, -0.0001, 0.0003, 9e13, 123456789.1234, 0.0])
    assert one(df, exact_sum("x", 4)) == Decimal("90000123456789.1237")


def test_checks_need_no_aggregate(spark):
    df = frame(spark, [1.0]).agg(exact_sum("x", 4).alias("a"), exact_sum("x").alias("b"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") == 3 and "max(" not in plan


def test_means_of_small_coefficients(spark):
    df = spark.createDataFrame([(1.25e-9,), (3.75e-9,)], "x double")
    assert one(df, exact_mean("x")) == pytest.approx(2.5e-9, rel=1e-9)


def test_sum_beyond_bigint_units(spark):
    df = spark.range(0, 40000).select(F.lit(9e12).alias("x"))
    assert one(df, exact_sum("x")) == 9e12 * 40000


def test_sum_of_negative_values(spark):
    assert one(frame(spark, [-1.25, -2.5, 0.5]), exact_sum("x")) == -3.25


def test_sum_of_counted_copies(spark):
    df = spark.createDataFrame([(1.5, 3), (-2.25, 2), (None, 4)], "x double, n long")
    assert one(df, nz_sum("x", "n")) == 0.0


def test_sum_of_nothing_is_zero(spark):
    df = frame(spark, [None, None])
    assert one(df, nz_sum("x")) == 0.0
    assert one(df, exact_sum("x")) is None
    assert one(df.where("false"), nz_sum("x")) == 0.0


def test_strict_sum_is_missing_with_a_hole(spark):
    assert one(frame(spark, [1.0, None]), strict_sum("x")) is None
    assert one(frame(spark, [1.0, 2.5]), strict_sum("x")) == 3.5
    marked = spark.createDataFrame([(1.0, True), (None, False)], "x double, k boolean")
    assert one(marked, strict_sum("x", "k")) == 1.0


def test_mean_of_nothing_is_missing(spark):
    assert one(frame(spark, [None]), exact_mean("x")) is None
    assert one(frame(spark, [1.0, None, 2.0]), exact_mean("x")) == 1.5


@pytest.mark.parametrize("sql", [False, True])
def test_choice_with_missing_condition(spark, sql):
    df = frame(spark, [0.0, 2.0, None])
    if sql:
        y = F.expr(na_if_else_sql("x = 0", "0D", "9D"))
    else:
        y = na_if_else(F.col("x") == 0, F.lit(0.0), F.lit(9.0))
    assert [r.y for r in df.select(y.alias("y")).collect()] == [0.0, 9.0, None]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    got = df.select(ratio(F.col("a"), F.col("b")).alias("y"), percent("a", "b").alias("p"))
    assert [(r.y, r.p) for r in got.collect()] == [(None, None), (None, None), (0.25, 25.0)]


def test_missing_sorts_last_both_ways(spark):
    df = frame(spark, [2.0, None, 1.0])
    assert [r.x for r in df.orderBy(ascending(F.col("x"))).collect()] == [1.0, 2.0, None]
    assert [r.x for r in df.orderBy(descending(F.col("x"))).collect()] == [2.0, 1.0, None]


def test_missing_text_reads_na(spark):
    df = frame(spark, ["a", None], "string")
    got = [r.y for r in df.select(na_concat(F.col("x"), ", ", F.col("x")).alias("y")).collect()]
    assert got == ["a, a", "NA, NA"]


def test_missing_counts_as_one_distinct_value(spark):
    df = frame(spark, ["a", "a", None, None, "b"], "string")
    assert one(df, distinct_with_missing("x")) == 3
    assert one(df.where("x = 'a'"), distinct_with_missing("x")) == 1


def test_halves_round_to_even(spark):
    df = frame(spark, [2.5, -2.5, 3.5, 0.5, None])
    got = [r.y for r in df.select(r_round(F.col("x")).alias("y")).collect()]
    assert got == [2.0, -2.0, 4.0, 0.0, None]
    df = frame(spark, [0.25, 0.75, 1234.565, 2.675])
    got = [tuple(r) for r in df.select(r_round("x", 1), r_round("x", 2)).collect()]
    assert [a for a, _ in got] == [0.2, 0.8, 1234.6, 2.7]
    assert got[3][1] in (2.67, 2.68)


def test_significant_digits(spark):
    df = frame(spark, [0.0, 123456.0, 0.0012345678, -98765.0, 1000.0, 99995.0, None])
    got = [r.y for r in df.select(signif("x", 4).alias("y")).collect()]
    assert got[:2] == [0.0, 123500.0]
    assert math.isclose(got[2], 0.001235, rel_tol=1e-12)
    assert got[3:] == [-98760.0, 1000.0, 100000.0, None]


def test_membership_and_year_tests(spark):
    df = frame(spark, ["1995", None, "1996"], "string")
    got = [r.y for r in df.select(is_member(F.col("x"), ["1995"]).alias("y")).collect()]
    assert got == [True, False, False]
    kept = df.where(missing_or_equal(F.col("x"), "1995")).collect()
    assert [r.x for r in kept] == ["1995", None]
    assert one(frame(spark, [None]), F.max(nz(F.col("x")))) == 0.0


def test_bins_are_half_open_and_complete(spark):
    bins = Bins((10, 20), ("low", "mid", "high"))
    df = frame(spark, [None, 0.0, 1e-9, 9.999, 10.0, 19.999, 20.0, 1e9, -1.0])
    got = [r.y for r in df.select(bins.label(F.col("x")).alias("y")).collect()]
    assert got == ["0", "0", "low", "low", "mid", "mid", "high", "high", None]
    with pytest.raises(ValueError):
        Bins((1,), ("only",))


@pytest.mark.parametrize(
    "name",
    ["CROP_SCARCITY", "HERD_SCARCITY", "CROP_WATER", "CROP_BLUE", "HERD_BLUE", "HERD_PASTURE"],
)
def test_published_bins_cover_every_value_once(spark, name):
    bins = getattr(published, name)
    edges = list(bins.edges)
    values = [0.0, 0.5 * edges[0]] + edges + [10 * edges[-1]]
    got = [r.y for r in frame(spark, [float(v) for v in values])
           .select(bins.label(F.col("x")).alias("y")).collect()]
    assert got == ["0", *bins.labels, bins.labels[-1]]


def test_unlabelled_zero(spark):
    df = frame(spark, [0.0, None, 5e-7, 1e-2])
    got = [r.y for r in df.select(published.BLUE_FLOW.label(F.col("x")).alias("y")).collect()]
    assert got == [None, None, "0-10^-6", ">10^-2"]
