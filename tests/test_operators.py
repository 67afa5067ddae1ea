"""Operators on small literal tables with gaps, ties, zeros and missing keys."""

import pytest
from pyspark.sql import functions as F

from hydroledger.operators import (
    basins,
    hotspot,
    layers,
    production as national,
    residual,
    savings,
    summary,
    tail,
    water,
)
from hydroledger.operators.compact import compact
from hydroledger.operators.model import Units, attributed, combine_flows
from hydroledger.plans.lookups import require_unique

ONE = Units(1.0, 1.0, 1.0, 1.0, 1.0)
FLOW = (
    "year string, bloc string, product string, origin_id string, basin string, volume double, "
    "green_m3 double, blue_m3 double, ha_def double, bwf double, bwsf double"
)


def flows(spark, data):
    return spark.createDataFrame(data, FLOW).withColumn("attributed", attributed())


@pytest.fixture
def trade(spark):
    y = "2015"
    return flows(
        spark,
        [
            (y, "A", "Soy", "M-1", "B1", 10.0, 1.25, 0.125, 1.0, 0.0, 0.0),
            (y, "A", "Soy", "M-2", "B1", 20.0, 2.0, 0.25, None, 5.0, 30.0),
            (y, "A", "Soy", "M-3", "B2", 30.0, 3.0, 0.5, 2.5, None, None),
            (y, "A", "Soy", "AGGREGATED-1", None, 40.0, 4.0, 1.0, 4.0, 2.0, 10.0),
            (y, "A", "Beef", "M-1", "B1", 5.0, 2.5, 0.5, None, 1.0, 8.0),
            (y, "A", "Beef", "AGGREGATED-1", None, 7.0, 3.5, 0.25, 0.5, None, None),
            (y, "H", "Soy", "M-1", "B1", 99.0, 9.0, 9.0, 9.0, 0.0, 0.0),
            (y, None, "Soy", "M-1", "B1", 77.0, 7.0, 7.0, 7.0, 0.0, 0.0),
        ],
    )


def test_product_summary(trade, rows):
    got = rows(summary.product_summary(trade, ["A"], ONE))
    crop = next(r for r in got if r["product"] == "Soy")
    herd = next(r for r in got if r["product"] == "Beef")
    # A missing coefficient adds nothing to the irrigated volume, a zero adds zero.
    assert (crop["vol_total"], crop["vol_irrigated"]) == (100.0, 60.0)
    assert (crop["green"], crop["blue"], crop["water"]) == (10.2, 1.88, 12.1)
    assert crop["cleared_total"] == 8.0  # 7.5 rounds to the even neighbour
    assert (herd["vol_total"], herd["vol_irrigated"]) == (12.0, 0.0)
    assert (herd["green"], herd["blue"], herd["water"]) == (6.0, 0.75, 6.8)


def test_bloc_totals_add_rounded_values(trade):
    got = summary.bloc_totals(summary.product_summary(trade, ["A"], ONE)).first()
    assert (got.green, got.blue, got.water) == (16.0, 2.63, 19.0)  # 16.25 m3 of green in fact


def test_compaction_changes_no_total(trade, rows):
    keys = ["year", "bloc", "product", "basin", "attributed", "bwf"]
    cells = compact(trade, keys, ["volume", "green_m3", "blue_m3", "ha_def"])
    want = rows(summary.product_summary(trade, ["A", "H"], ONE))
    assert rows(summary.product_summary(cells, ["A", "H"], ONE)) == want
    # A cell without any value stays missing.
    assert cells.where("product = 'Beef' AND attributed").first().ha_def is None


def test_basin_rows_keep_crop_flows_without_place(trade, spark, rows):
    labels = spark.createDataFrame([("B1", "high"), (None, "unknown")], "basin string, scarcity string")
    totals = summary.bloc_totals(summary.product_summary(trade, ["A"], ONE))
    got = basins.basin_footprint(trade, totals, labels, ["A"], ONE)
    assert got.count() == 4  # three crop rows, one herd row
    assert {(r["basin"], r["scarcity"]) for r in rows(got)} == {
        ("B1", "high"),
        ("B2", None),
        (None, "unknown"),
    }
    rolled = {r["scarcity"]: r for r in rows(basins.basin_scarcity_rollup(got))}
    # The bloc total is added once per basin row.
    assert rolled["high"]["water_bloc"] == 2 * 19.0
    assert rolled[None]["water_bloc"] == 19.0
    blue = basins.basin_blue_share(got, totals)
    shares = {r["scarcity"]: r["pct"] for r in rows(basins.basin_blue_scarcity_rollup(blue))}
    assert shares == {"high": 33.0, "unknown": 38.0, None: 19.0}


def test_zero_total_gives_missing_share(spark):
    data = [("2015", "A", "Soy", "M-1", "B1", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = flows(spark, data)
    totals = summary.bloc_totals(summary.product_summary(df, ["A"], ONE))
    labels = spark.createDataFrame([("B1", "low")], "basin string, scarcity string")
    assert basins.basin_footprint(df, totals, labels, ["A"], ONE).first().pct is None


def test_irrigated_share_skips_groups_without_scarcity(spark, rows):
    df = flows(
        spark,
        [
            ("2015", "A", "Soy", "M-1", "B", 1.0, 1.0, 1.0, 1.0, 1.0, 3.0),
            ("2015", "A", "Soy", "M-2", "B", 3.0, 1.0, 1.0, 1.0, 1.0, None),
            ("2016", "A", "Soy", "M-2", "B", 3.0, 1.0, 1.0, 1.0, 1.0, 0.0),
        ],
    )
    got = rows(summary.irrigated_import_share(df, ["A"]))
    assert [(r["year"], r["pct_irrigated"]) for r in got] == [("2015", 25.0)]


PRODUCED = (
    "year string, product string, origin_id string, state_code int, tonnes double, wf double, "
    "gwf double, bwf double, def_per_t double, co2_per_t double, co2_low_per_t double, "
    "co2_high_per_t double"
)


def test_residual_plus_exports_is_production(spark, rows):
    produced = spark.createDataFrame(
        [
            ("2015", "Beef", "M-1", 1, 10.0, 1.0, 2.0, 0.5, 0.1, 1.0, 0.5, 1.5),
            ("2015", "Beef", "M-2", 1, 4.0, 1.0, None, 0.5, 0.1, 1.0, 0.5, 1.5),
            ("2015", "Beef", "M-3", 2, 8.0, 1.0, 3.0, 0.25, 0.2, 1.0, 0.5, 1.5),
            ("2015", "Soy", "M-3", 3, 8.0, 1.0, 3.0, 0.25, 0.2, 1.0, 0.5, 1.5),
            ("2015", "Beef", "M-4", None, 9.0, 1.0, 1.0, 0.25, 0.2, 1.0, 0.5, 1.5),
        ],
        PRODUCED,
    )
    out = spark.createDataFrame(
        [
            ("2015", "Beef", 1, 16.0, 5.0, 1.0, 0.5, 0.25, 0.75, 1.0),
            ("2015", "Beef", None, 4.0, 5.0, 1.0, 0.5, 0.25, 0.75, 1.0),
        ],
        "year string, product string, state_code int, volume double, green_m3 double, "
        "blue_m3 double, co2_def double, co2_low double, co2_high double, ha_def double",
    )
    got = {
        r["state_code"]: r
        for r in rows(residual.state_domestic_residual(produced, residual.state_exports(out)))
    }
    assert set(got) == {1, 2, None}
    assert got[None]["volume"] == 5.0
    assert (got[1]["produced"], got[1]["volume"]) == (14.0, -2.0)  # may be negative
    assert got[1]["green_m3"] == 20.0 - 5.0  # the missing coefficient adds nothing
    assert (got[2]["volume"], got[2]["green_m3"]) == (8.0, 24.0)  # nothing exported


def test_unknown_volume_of_a_year_is_taken_off(spark):
    part = spark.createDataFrame(
        [("2015", 2e6, 1e6, 1e9, 2e9, 1e6, 3e6, 4e6), ("2018", 1e6, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
        "year string, volume double, cleared double, blue_m3 double, green_m3 double, "
        "co2_def double, co2_low double, co2_high double",
    )
    unknown = residual.unknown_origin(spark)
    assert unknown.count() == 3
    got = {r.year: r for r in residual.national_domestic_residual(part, unknown).collect()}
    assert got["2015"].mass == 1.86
    assert (got["2015"].co2_mean, got["2015"].co2_total) == (4.0, 5.0)  # 3.5 to even
    assert got["2018"].mass is None


def test_median_and_savings(spark, rows):
    produced = spark.createDataFrame(
        [
            ("2015", p, f"M-{i}", 1, 1.0, wf, 0.0, bwf, 0.0, 0.0, 0.0, 0.0)
            for p in ("Soy", "Beef")
            for i, (wf, bwf) in enumerate([(0.0, 0.0), (10.0, 4.0), (20.0, 8.0), (33.333, None)])
        ],
        PRODUCED,
    )
    medians = savings.median_footprint(produced)
    assert {r["product"]: r["median"] for r in rows(medians)} == {"Soy": 20.0, "Beef": 6.0}
    bench = produced.select("year", "product", "origin_id", "wf", "bwf").withColumn(
        "tag_wf", F.when(F.col("wf") > 15, "> cutoff WF").otherwise("< cutoff WF")
    )
    data = [
        ("2015", "A", p, f"M-{i}", "B", v, 0.0, 0.0, 0.0, 0.0, 0.0)
        for p in ("Soy", "Beef")
        for i, v in [(1, 100.0), (2, 3.0), (2, 3.0), (3, 1.2345), (9, 50.0)]
    ]
    df = flows(spark, data)
    got = {
        r["product"]: r
        for r in rows(savings.median_savings(df, bench, medians, ["A"], ["2015"], units=ONE))
    }
    assert got["Soy"]["at_median"] == 60.0 + 60.0 + 24.69
    assert got["Soy"]["as_is"] == 60.0 + 60.0 + 41.15
    assert got["Soy"]["savings"] == 16.46
    assert got["Beef"]["at_median"] == pytest.approx(6 * 7.2345, abs=1e-9)
    assert got["Beef"]["as_is"] == 48.0  # the missing coefficient adds nothing
    counted = df.groupBy("year", "bloc", "product", "origin_id", "volume").agg(
        F.count("*").alias("copies")
    )
    same = savings.median_savings(counted, bench, medians, ["A"], ["2015"], units=ONE)
    assert {r["product"]: r for r in rows(same)} == got
    # Flows with both coefficients use their own.
    own = df.withColumns({"wf": F.lit(1.0), "bwf": F.lit(2.0)})
    same = rows(savings.median_savings(own, bench, medians, ["A"], ["2015"], units=ONE))
    assert {r["product"]: r["as_is"] for r in same} == {"Soy": 7.23, "Beef": 14.469}


def test_savings_table_leaves_out_the_domestic_bloc(spark, rows):
    part = spark.createDataFrame(
        [(b, 1.0, 3.0, 2.0, 2.0, "2015", p) for b in ("A", "H") for p in ("Soy", "Beef")],
        "bloc string, at_median double, as_is double, median double, savings double, "
        "year string, product string",
    )
    crop = spark.createDataFrame(
        [("2015", b, "Soy", 8.0, 1.0) for b in ("A", "H")],
        "year string, bloc string, product string, water double, blue double",
    )
    herd = crop.withColumn("product", F.lit("Beef")).withColumn("blue", F.lit(0.0))
    got = savings.savings_table(part, crop, herd, "H").collect()
    assert [(r.bloc, r["product"], r.type, r.pct_savings) for r in got] == [
        ("A", "Soy", "green + blue", 25.0),
        ("A", "Beef", "blue only", None),
        ("H", "Soy", None, None),
        ("H", "Beef", None, None),
    ]


@pytest.fixture
def tail_flows(spark):
    y, b = "2015", "A"
    return flows(
        spark,
        [
            (y, b, "Soy", "M-1", "B", 50.0, 0.0, 0.0, 1.0, 1.0, 10.0),
            (y, b, "Soy", "M-3", "B", 20.0, 0.0, 0.0, 2.0, 1.0, 20.0),
            (y, b, "Soy", "M-2", "B", 15.0, 0.0, 0.0, 4.0, 1.0, 20.0),  # ties with M-3
            (y, b, "Soy", "M-2", "B", 5.0, 0.0, 0.0, None, 1.0, 20.0),
            (y, b, "Soy", "M-4", "B", 10.0, 0.0, 0.0, 8.0, 0.0, 30.0),  # not in the base
            (y, b, "Soy", "M-5", "B", 500.0, 0.0, 0.0, 16.0, 0.0, 0.0),  # not ranked
            (y, b, "Soy", "AGGREGATED-1", None, 300.0, 0.0, 0.0, 32.0, None, None),
            (y, b, "Beef", "M-1", "B", 80.0, 0.0, 0.0, 1.0, 1.0, 10.0),
            (y, b, "Beef", "M-2", "B", 10.0, 0.0, 0.0, 2.0, 1.0, 0.0),
            (y, b, "Beef", "AGGREGATED-1", None, 10.0, 0.0, 0.0, 4.0, None, None),
        ],
    )


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_tail_origins(tail_flows, rows, settings, coalesce):
    settings(spark__sql__adaptive__coalescePartitions__enabled=coalesce)
    got = rows(tail.tail_origins(tail_flows, ["A"], ["2015"]))
    crop = [r for r in got if r["product"] == "Soy"]
    herd = [r for r in got if r["product"] == "Beef"]
    # Base: irrigated volume 90, from the blue coefficient; order: M-1, M-2, M-3, M-4.
    assert [(r["origin_id"], r["volume_cum"], r["vol_base"]) for r in crop] == [
        ("M-3", 90.0, 90.0),
        ("M-4", 100.0, 90.0),
    ]
    assert crop[1]["perc"] == 100.0 / 90.0
    # Herd: zero first, missing last and therefore in the tail.
    assert [(r["origin_id"], r["perc"]) for r in herd] == [("AGGREGATED-1", 1.0), ("M-1", 0.9)]


def test_tail_clearing_share(tail_flows, rows):
    got = {r["product"]: r for r in rows(tail.tail_clearing_share(tail_flows, ["A"], ["2015"], units=ONE))}
    assert (got["Soy"]["mass"], got["Soy"]["ha_def"], got["Soy"]["cleared_total"]) == (30.0, 10.0, 63.0)
    assert got["Soy"]["pct_cleared"] == 16.0
    assert (got["Beef"]["ha_def"], got["Beef"]["pct_cleared"]) == (5.0, 71.0)


def test_tail_layer_uses_ranked_rows_as_base(tail_flows, spark, rows):
    place = spark.createDataFrame([(f"M-{i}", f"P{i}") for i in range(1, 5)], "origin_id string, geometry string")
    got = rows(tail.tail_layer(tail_flows, place, "Soy", ["A"], ["2015"]))
    assert [(r["origin_id"], r["perc"], r["vol_irrigated"]) for r in got] == [
        ("M-3", 0.9, 100.0),
        ("M-4", 1.0, 100.0),  # the last share is one
    ]
    herd = rows(tail.tail_layer(tail_flows, place, "Beef", ["A"], ["2015"]))
    assert [r["origin_id"] for r in herd] == ["M-1"]  # no place, no row


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(
        [
            ("2015", "Soy", "M-1", 1.0, "> cutoff def", "irr", "< cutoff WSF", "> cutoff WF"),
            ("2015", "Soy", "M-2", 2.0, "> cutoff def", "no irr", "> cutoff WSF", "< cutoff WF"),
            ("2015", "Soy", "M-3", None, "> cutoff def", "irr", None, None),
            ("2015", "Beef", "M-1", 1.0, "> cutoff def", "irr", "> cutoff WSF", "> cutoff WF"),
            ("2015", "Beef", "M-2", 1.0, "< cutoff def", "irr", "> cutoff WSF", "> cutoff WF"),
        ],
        "year string, product string, origin_id string, bwf double, tag_def string, "
        "tag_irr string, tag_wsf string, tag_wf string",
    )


def test_hotspots(spark, bench, rows):
    data = [
        ("2015", "A", p, o, "B", v, 0.0, 0.0, ha, c, 0.0)
        for p in ("Soy", "Beef")
        for o, v, ha, c in [
            ("M-1", 1.0, 10.0, 1.0),
            ("M-1", 2.0, None, 9.0),
            ("M-2", 4.0, 20.0, 2.0),
            ("M-3", 8.0, 30.0, None),
            (None, 16.0, 40.0, None),
        ]
    ]
    df = flows(spark, data)
    got = rows(hotspot.hotspot_origins(df, bench, ["A"], ["2015"]))
    assert sorted((r["product"], r["origin_id"], r["volume"]) for r in got) == [
        ("Beef", "M-1", 1.0),
        ("Beef", "M-1", 2.0),
        ("Soy", "M-1", 1.0),
        ("Soy", "M-1", 2.0),
        ("Soy", "M-3", 8.0),
    ]
    # With the shared coefficient as a further key, missing matches missing.
    strict = hotspot.hotspot_origins(df, bench, ["A"], ["2015"], ["Soy"], coefficient="bwf")
    assert sorted(r.volume for r in strict.collect()) == [1.0, 8.0]
    share = {r["product"]: r for r in rows(hotspot.hotspot_clearing_share(df, bench, ["A"], ["2015"], ONE))}
    assert share["Soy"] == {
        "year": "2015",
        "bloc": "A",
        "product": "Soy",
        "mass": 11.0,
        "ha_def": 40.0,
        "n_origins": 2,
        "cleared_total": 100.0,
        "pct_cleared": 40.0,
    }
    assert (share["Beef"]["mass"], share["Beef"]["n_origins"]) == (3.0, 1)
    holes = df.withColumn("volume", F.when(F.col("volume") != 2, F.col("volume")))
    share = rows(hotspot.hotspot_clearing_share(holes, bench, ["A"], ["2015"], ONE))
    assert all(r["mass"] is None for r in share)
    assert hotspot.hotspot_clearing_share(df, bench, ["A"], ["2016"], ONE).count() == 0
    counts = {r["product"]: r["n_origins"] for r in rows(hotspot.origin_counts(df, ["A"]))}
    assert counts == {"Soy": 4, "Beef": 4}  # the unnamed origin counts


@pytest.fixture
def series(spark):
    y = "2015"
    df = flows(
        spark,
        [
            (y, "A", "Soy", "M-1", "B1", 1.0, 3.0, 0.0, 0.0, 0.0, 0.0),
            (y, "A", "Soy", "M-1", "B1", 1.0, 1.0, None, 0.0, 0.0, 0.0),
            (y, "A", "Beef", "M-2", "B2", 1.0, 0.0, 2.0, 0.0, 0.0, 0.0),
            (y, "A", "Beef", "M-9", None, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0),
            (y, "C", "Soy", "M-3", "B3", 1.0, 4.0, 0.0, 0.0, 0.0, 0.0),
            (y, "C", "Soy", "AGGREGATED-1", None, 1.0, 5.0, 5.0, 0.0, 0.0, 0.0),
            (y, "C", "Soy", "M-4", "B4", 1.0, 1.0, -1.0, 0.0, 0.0, 0.0),
            (y, "C", "Soy", "M-4", "B4", 1.0, 1.0, 1.0, 0.0, 0.0, 0.0),
        ],
    )
    grain = ("year", "bloc", "origin_id", "basin", "attributed")
    return water.water_long(df, ["A", "C"], ONE, grain)


def test_water_long_drops_colours_without_water(series, rows):
    got = {(r["origin_id"], r["type"]): (r["type_rank"], r["water"]) for r in rows(series)}
    assert got == {
        ("M-1", "Soy - Green"): (1, 4.0),
        ("M-2", "Beef - Blue"): (4, 2.0),
        ("M-9", "Beef - Blue"): (4, 1.0),
        ("M-3", "Soy - Green"): (1, 4.0),
        ("M-4", "Soy - Green"): (1, 2.0),
        ("M-4", "Soy - Blue"): (3, 0.0),  # flows that cancel out are not zero flows
        ("AGGREGATED-1", "Soy - Green"): (1, 5.0),
        ("AGGREGATED-1", "Soy - Blue"): (3, 5.0),
    }
    ranks = [r.type_rank for r in water.in_series_order(series).collect()]
    assert ranks == sorted(ranks)


def test_every_basin_is_in_every_panel(series, rows):
    domain = water.basin_domain(series)
    assert sorted(r.basin for r in domain.collect()) == ["B1", "B2", "B3", "B4"]
    panel = rows(water.basin_panel(series, domain, ["2015", "2016"], ["A", "C"], units=ONE))
    for year in ("2015", "2016"):
        for bloc in ("A", "C"):
            shown = {r["basin"] for r in panel if (r["year"], r["bloc"]) == (year, bloc)}
            assert {"B1", "B2", "B3", "B4"} <= shown
    filled = [r for r in panel if r["water"] == 0 and r["year"] == "2016"]
    assert len(filled) == 8 and {r["type"] for r in filled} == {"Beef - Blue"}
    assert [r["water"] for r in panel if r["basin"] is None] == [1.0]  # kept, not filled
    missing = water.missing_basins(series, domain, ["2015"], ["A", "C"])
    assert sorted((r.bloc, r.basin) for r in missing.collect()) == [
        ("A", "B3"),
        ("A", "B4"),
        ("C", "B1"),
        ("C", "B2"),
    ]
    blue = rows(water.basin_panel(series, domain, ["2015"], ["A"], water.BLUE_TYPES, ONE))
    assert {r["basin"]: r["water"] for r in blue} == {"B1": 0.0, "B2": 2.0, "B3": 0.0, "B4": 0.0, None: 1.0}


def test_basin_order_and_axis(series, rows):
    domain = water.basin_domain(series)
    order = water.basin_order(series, domain, ["2015"], "A")
    assert [r["basin"] for r in sorted(rows(order), key=lambda r: r["position"])] == [
        "B3",
        "B4",
        None,
        "B2",
        "B1",
    ]
    panel = water.basin_panel(series, domain, ["2015"], ["C"], units=ONE)
    placed = {r["basin"]: r["position"] for r in rows(water.ordered_panel(panel, order))}
    assert placed == {"B1": 5, "B2": 4, "B3": 1, "B4": 2}
    axis = water.basin_axis_totals(series, "Green + Blue", units=ONE)
    assert {(r["bloc"], r["basin"]): r["water"] for r in rows(axis)}[("C", "B4")] == 2.0
    assert water.axis_max(axis).first().axis_max == 4.0  # the unlinked flow is left out


@pytest.fixture
def place(spark):
    return spark.createDataFrame(
        [("M-1", "P1"), ("M-2", "P2"), ("M-NODATA", "P0")], "origin_id string, geometry string"
    )


def test_layers_keep_unseen_places_and_drop_other_years(spark, place, rows):
    produced = spark.createDataFrame(
        [
            ("2017", "Soy", "M-1", 700.0),
            ("2015", "Soy", "M-2", 100.0),
            ("2017", "Soy", "M-7", None),
            ("2017", "Beef", "M-2", 5.0),
        ],
        "year string, product string, origin_id string, coef double",
    )
    full = produced.withColumns({c: F.col("coef") for c in ("wf", "gwf", "bwf", "bwsf")})
    got = rows(layers.crop_blue_bins(full, place, "2017"))
    assert [(r["origin_id"], r["year"], r["bin"], r["geometry"]) for r in got] == [
        ("M-1", "2017", "500-1000", "P1"),
        ("M-7", "2017", "0", None),
        ("M-NODATA", None, "0", "P0"),
    ]
    assert [r["origin_id"] for r in rows(layers.crop_scarcity_bins(full, place, "2017"))] == ["M-1"]
    assert layers.herd_scarcity_bins(full, place, "2017").count() == 3
    zero = full.withColumn("wf", F.lit(0.0))
    assert {r["coef"] for r in rows(layers.crop_water_bins(zero, place, "2017"))} == {None}


def test_blue_map_layer(series, place, rows):
    got = rows(layers.blue_map_layer(series, place, ["2015"], ["A", "C"], Units(water=1e-3)))
    assert [(r["bloc"], r["origin_id"], r["bin"], r["geometry"]) for r in got] == [
        ("A", "M-2", "10^-4-10^-2", "P2"),
        ("A", "M-9", "10^-4-10^-2", None),
        ("C", "M-4", None, None),
    ]


def test_bench_classes_keep_every_place(bench, place, rows):
    got = rows(layers.crop_bench_classes(bench, place, "2015", "> cutoff def"))
    assert {r["origin_id"]: r["tag"] for r in got} == {
        "M-1": "> cutoff WF, irr",
        "M-2": "< cutoff WF, no irr",
        "M-3": "NA, irr",
        "M-NODATA": None,
    }
    below = rows(layers.herd_bench_classes(bench, place, "2015", "< cutoff def"))
    assert {r["origin_id"]: r["tag"] for r in below} == {
        "M-1": None,
        "M-2": "> cutoff WF, > cutoff WSF",
        "M-NODATA": None,
    }


def test_production_summaries(spark):
    crop = spark.createDataFrame(
        [
            ("2015", "Soy", 10e6, 4e6, 1e6, 2e6, 100.0, 90.0, 10.0, None),
            ("2015", "Soy", 20e6, 6e6, None, 3e6, 200.0, None, 20.0, 1e6),
        ],
        "year string, product string, tonnes double, planted_ha double, def_ha double, "
        "ghg_t double, wf double, gwf double, bwf double, irrigated_ha double",
    )
    got = national.crop_production_summary(crop).first()
    assert (got.mass, got.planted, got.cleared, got.co2) == (30.0, 10.0, 1.0, 5.0)
    assert (got.water, got.green, got.blue, got.irrigated) == (5.0, 1.0, 0.5, 1.0)
    assert (got["yield"], got.cleared_per_kt, got.co2_per_t) == (3.0, 33.0, 0.17)
    assert (got.water_per_t, got.blue_per_t, got.pct_blue) == (167.0, 17.0, 10.18)
    herd = spark.createDataFrame(
        [("2015", 2e9, 3e6, 1e5, 2e6, 4e9, 2e9, 5e9, 1e8, 3e8, 0.5, 1.25),
         ("2015", 0.0, None, None, None, None, None, None, None, None, 1.5, None),
         ("2014", 2e9, 3e6, 1e5, 2e6, 4e9, 2e9, 5e9, 1e8, 3e8, 0.5, 1.25),
         ("bad", 2e9, 3e6, 1e5, 2e6, 4e9, 2e9, 5e9, 1e8, 3e8, 0.5, 1.25)],
        "year string, live_kg double, pasture_ha double, def_ha double, ghg_t double, "
        "co2_high_kg double, co2_low_kg double, pasture_m3 double, animal_m3 double, "
        "reservoir_m3 double, water_ha double, stock double",
    ).withColumn("product", F.lit("Beef"))
    rows = national.herd_production_summary(herd, ["2015"]).collect()
    assert len(rows) == 1
    assert (rows[0].mass, rows[0].pasture, rows[0].cleared) == (2.0, 3.0, 0.1)
    assert rows[0].water_area == 0.0 and rows[0].stock_mean == 1.25
    assert rows[0].pasture_per_t == 2500.0


def test_combined_tables_and_key_check(spark):
    crop = spark.createDataFrame([("M-1", 1.0)], "origin_id string, volume double")
    herd = spark.createDataFrame([("AGGREGATED-2", 2.0), (None, 3.0)], "origin_id string, volume double")
    both = combine_flows(crop, herd)
    assert {(r["product"], r.attributed) for r in both.collect()} == {
        ("Soy", True),
        ("Beef", False),
        ("Beef", None),
    }
    assert require_unique(both, ["origin_id"]).count() == 3
    with pytest.raises(Exception, match="repeat"):
        require_unique(both.union(both), ["origin_id"]).collect()


def test_repeated_tags_fail_instead_of_multiplying(spark, bench):
    df = flows(spark, [("2015", "A", "Soy", "M-1", "B", 1.0, 0.0, 0.0, 1.0, 1.0, 10.0)])
    twice = bench.withColumn("wf", F.lit(1.0))
    twice = twice.union(twice)
    medians = spark.createDataFrame([("2015", "Soy", 1.0)], "year string, product string, median double")
    for run in (
        lambda b: hotspot.hotspot_origins(df, b, ["A"], ["2015"]),
        lambda b: hotspot.hotspot_clearing_share(df, b, ["A"], ["2015"], ONE),
        lambda b: savings.median_savings(df, b, medians, ["A"], ["2015"], units=ONE),
    ):
        with pytest.raises(Exception, match="repeat"):
            run(twice).collect()


def test_zero_base_keeps_its_tail(spark, settings, rows):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    y, b = "2015", "A"
    df = flows(
        spark,
        [(y, b, "Soy", f"M-{i}", "B", 2.0, 0.0, 0.0, 1.0, 0.0, float(i)) for i in range(1, 30)],
    )
    got = rows(tail.tail_origins(df, ["A"], ["2015"]))
    # The blue coefficient is zero, so the base is; all 29 ranked origins are beyond it.
    assert len(got) == 29
    assert {r["vol_base"] for r in got} == {0.0} and {r["perc"] for r in got} == {None}
    assert max(r["volume_cum"] for r in got) == 58.0


def test_ratios_do_not_depend_on_the_reported_units(spark):
    crop = spark.createDataFrame(
        [("2015", "Soy", 4e9, 2e9, 6e8, 8e8, 2000.0, 1900.0, 100.0, 1e6)],
        "year string, product string, tonnes double, planted_ha double, def_ha double, "
        "ghg_t double, wf double, gwf double, bwf double, irrigated_ha double",
    )
    herd = spark.createDataFrame(
        [("2015", 4e12, 3e9, 1e8, 2e9, 4e12, 8e12, 5e12, 1e12, 3e12, 0.5, 1.25)],
        "year string, live_kg double, pasture_ha double, def_ha double, ghg_t double, "
        "co2_high_kg double, co2_low_kg double, pasture_m3 double, animal_m3 double, "
        "reservoir_m3 double, water_ha double, stock double",
    ).withColumn("product", F.lit("Beef"))
    other = Units(mass=1e-3, area=1e-4, carbon=1e-5, water=1e-7, kilograms=1e-8)
    for run, names in (
        (
            lambda u: national.crop_production_summary(crop, u),
            ["yield", "cleared_per_kt", "co2_per_t", "water_per_t", "green_per_t", "blue_per_t", "pct_blue"],
        ),
        (
            lambda u: national.herd_production_summary(herd, ["2015"], u),
            ["cleared_per_kt", "co2_def_per_t", "co2_low_per_t", "co2_high_per_t", "pasture_per_t", "animal_per_t", "reservoir_per_t"],
        ),
    ):
        ours, theirs = run(Units()).first(), run(other).first()
        assert [ours[n] for n in names] == [theirs[n] for n in names]
        assert all(ours[n] for n in names)


def test_flows_of_a_hot_origin_spread_over_tasks(spark, bench, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="32",
    )
    n = 20_000
    df = spark.range(n).select(
        F.lit("2015").alias("year"),
        F.lit("A").alias("bloc"),
        F.lit("Soy").alias("product"),
        F.when(F.col("id") % 3 == 0, "M-1").otherwise(F.concat(F.lit("X-"), "id")).alias("origin_id"),
        (F.col("id") * 0.25).alias("volume"),
        F.lit(1.0).alias("ha_def"),
    )
    got = hotspot.hotspot_origins(df, bench, ["A"], ["2015"])
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == -(-n // 3)
    assert len(sizes) >= 8 and sizes[-1] <= sum(sizes) / 3
