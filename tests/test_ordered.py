"""Running totals and medians against brute force, over several range parts."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hydroledger.operators import ordered
from hydroledger.operators.ordered import BRACKET, exact_median, range_parts, running_total
from hydroledger.plans.staging import stage


@pytest.fixture
def many_parts(settings):
    settings(
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="8",
    )


def brute(data):
    """Running totals per key in plain Python, missing order values last."""
    groups = defaultdict(list)
    for key, order, tie, value in data:
        groups[key].append((order is None, order or 0.0, tie, value))
    out = {}
    for key, members in groups.items():
        total = 0.0
        for _, _, tie, value in sorted(members, key=lambda m: m[:3]):
            total += value or 0.0
            out[key, tie] = total
    return out


def skewed(n=3000, seed=1):
    """A third of the rows share one order value, some have none; one key is hot."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        order = rng.choice([0.0, float(rng.randint(0, 40)), rng.random() * 100])
        order = None if rng.random() < 0.1 else order
        value = None if rng.random() < 0.05 else rng.randint(0, 500) / 100
        data.append((key, order, f"T-{i:05d}", value))
    return data


def test_running_total_matches_brute_force(spark, many_parts):
    data = skewed()
    df = spark.createDataFrame(data, "k string, o double, t string, v double").repartition(5)
    parts = range_parts(df, ["k"], ["o", "t"])
    assert parts.select("_part").distinct().count() > 4
    assert parts.where("k = 'hot' AND o = 0.0").select("_part").distinct().count() > 1
    got = running_total(parts, ["k"], ["o", "t"], "v", "c").collect()
    want = brute(data)
    assert len(got) == len(data)
    assert {(r.k, r.t): r.c for r in got} == pytest.approx(want)


def test_parts_below_the_cut_are_not_sorted_but_nothing_is_lost(spark, many_parts):
    data = skewed(seed=2)
    df = spark.createDataFrame(data, "k string, o double, t string, v double")
    parts = range_parts(df, ["k"], ["o", "t"])
    groups = parts.groupBy("k").agg(F.sum("v").alias("whole"))
    cut = running_total(
        parts,
        ["k"],
        ["o", "t"],
        "v",
        "c",
        groups=groups,
        keep=lambda before, reach: reach / F.col("whole") > 0.8,
    )
    plain = running_total(parts, ["k"], ["o", "t"], "v", "c", groups=groups)
    assert cut.count() < plain.count()
    above = F.col("c") / F.col("whole") > 0.8
    assert set(cut.where(above).collect()) == set(plain.where(above).collect())
    assert cut.where(above).count() == plain.where(above).count() > 0


def test_negative_values_keep_every_part_that_may_reach_the_cut(spark, many_parts):
    data = [("k", float(i), f"{i:04d}", 5.0 if i % 2 else -4.0) for i in range(400)]
    df = spark.createDataFrame(data, "k string, o double, t string, v double")
    parts = range_parts(df, ["k"], ["o", "t"])
    full = running_total(parts, ["k"], ["o", "t"], "v", "c").where("c > 150")
    cut = running_total(
        parts, ["k"], ["o", "t"], "v", "c", keep=lambda before, reach: reach > 150
    ).where("c > 150")
    assert sorted(full.collect()) == sorted(cut.collect())


@pytest.mark.parametrize("seed", range(4))
def test_median_matches_brute_force(spark, many_parts, seed):
    rng = random.Random(seed)
    data = []
    for i in range(1500 + seed):
        key = "hot" if rng.random() < 0.6 else "cold"
        value = 7.25 if rng.random() < 0.33 else rng.random() * 20
        data.append((key, None if rng.random() < 0.05 else value))
    data += [("single", 3.5), ("pair", 1.0), ("pair", 4.0), ("none", None)]
    data += [(None, 1.5), (None, 2.5)]  # a missing key is a group of its own
    df = spark.createDataFrame(data, "k string, x double")
    got = {r.k: r.m for r in exact_median(df, ["k"], "x", "m").collect()}
    values = defaultdict(list)
    for key, value in data:
        if value is not None:
            values[key].append(value)
    assert got == {k: statistics.median(v) for k, v in values.items()}


@pytest.mark.parametrize("bracket", [0.0, 1e-6, BRACKET, 0.1, 0.5])
def test_medians_of_any_bracket(spark, bracket):
    rng = random.Random(8)
    data = [("wide", rng.gauss(0, 1) * 10 ** rng.randint(-9, 9)) for _ in range(30_001)]
    data += [("half", float(i >= 5000)) for i in range(10_000)]  # the middle lies between two values
    data += [("tied", 4.5)] * 9000 + [("few", float(i)) for i in range(8)]
    df = spark.createDataFrame(data, "k string, x double").repartition(11)
    values = defaultdict(list)
    for key, value in data:
        values[key].append(value)
    got = {r.k: r.m for r in exact_median(df, ["k"], "x", "m", bracket).collect()}
    assert got == {k: statistics.median(v) for k, v in values.items()}


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    # Quantiles as crude as they get: their error exceeds the bracket by far.
    monkeypatch.setattr(ordered, "ACCURACY", 2)
    rng = random.Random(4)
    data = [(i % 3, rng.random() ** 5) for i in range(60_000)]
    df = spark.createDataFrame(data, "k int, x double").repartition(13)
    got = {r.k: r.m for r in exact_median(df, ["k"], "x", "m", 1e-5).collect()}
    assert got == {k: statistics.median([x for j, x in data if j == k]) for k in range(3)}


def test_only_the_middle_of_a_group_is_shuffled(spark):
    df = spark.range(400_000).select(F.lit("hot").alias("k"), F.rand(5).alias("x"))
    median = exact_median(stage(df), ["k"], "x", "m")
    assert median.count() == 1
    ends = [0.5 - BRACKET, 0.5 + BRACKET]
    low, high = df.select(F.percentile_approx("x", ends, F.lit(ordered.ACCURACY))).first()[0]
    assert df.where((F.col("x") >= low) & (F.col("x") <= high)).count() < 400_000 * 0.003


def test_ties_are_decided_by_the_last_order_column(spark):
    df = spark.createDataFrame(
        [("k", 1.0, "b", 1.0), ("k", 1.0, "a", 2.0)], "k string, o double, t string, v double"
    )
    got = running_total(range_parts(df, ["k"], ["o", "t"]), ["k"], ["o", "t"], "v", "c").collect()
    assert {r.t: r.c for r in got} == {"a": 2.0, "b": 3.0}
