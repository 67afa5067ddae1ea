"""Flows from origins with high clearing and a water problem."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    ascending,
    descending,
    distinct_with_missing,
    nz_sum,
    percent,
    r_round,
    strict_sum,
)
from ..plans.lookups import require_unique
from .model import (
    ABOVE_DEF,
    ABOVE_WSF,
    IRRIGATED,
    NATIONAL,
    PRODUCTS,
    Units,
    by_product,
    of_years,
)
from .summary import KEYS, of_blocs

ORIGIN = ("year", "product", "origin_id")
#: Tasks that the flows of one origin are spread over.
SALTS = 16


def hotspot_places(bench: DataFrame) -> DataFrame:
    """Origins above the clearing cutoff that irrigate (crop) or exceed the
    scarcity cutoff (herd)."""
    water = by_product(F.col("tag_irr") == IRRIGATED, F.col("tag_wsf") == ABOVE_WSF)
    return bench.where((F.col("tag_def") == ABOVE_DEF) & water)


def hotspot_origins(
    flows: DataFrame,
    bench: DataFrame,
    blocs: Sequence[str],
    years: Sequence[str],
    products: Sequence[str] = PRODUCTS,
    coefficient: str | None = None,
) -> DataFrame:
    """Single flows from hotspot origins.

    ``coefficient`` names a per-tonne column found in both tables that must agree as
    well, missing matching missing; by default year, product and origin decide.  An
    origin that is tagged twice fails the job.
    """
    keys = list(ORIGIN)
    hot = of_years(hotspot_places(bench), years).where(F.col("product").isin(*products))
    hot = require_unique(hot.select(*keys, *([coefficient] if coefficient else [])), keys)
    kept = of_blocs(of_years(flows, years), blocs).where(F.col("product").isin(*products))
    # Single flows of one origin may be a third of all: they are spread by what they hold.
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64(*kept.columns), F.lit(SALTS)))
    hot = hot.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    keys = [*keys, "_salt"]
    if coefficient is None:
        joined = kept.join(hot.select(*keys), keys, "left_semi")
    else:
        side = hot.select(*[F.col(c).alias(f"_{c}") for c in (*keys, coefficient)])
        same = [F.col(c) == F.col(f"_{c}") for c in keys]
        same.append(F.col(coefficient).eqNullSafe(F.col(f"_{coefficient}")))
        joined = kept.join(side, same, "left_semi")
    return joined.select("year", "origin_id", "bloc", "product", "volume", "ha_def")


def hotspot_clearing_share(
    flows: DataFrame,
    bench: DataFrame,
    blocs: Sequence[str],
    years: Sequence[str],
    units: Units = NATIONAL,
) -> DataFrame:
    """Clearing of the hotspot flows as a share of all clearing of their group.

    One pass over the flows: the hotspot mark is joined to every flow, and both the
    marked sums and the totals come from the same aggregate.
    """
    hot_places = of_years(hotspot_places(bench), years).select(*ORIGIN)
    marks = require_unique(hot_places, ORIGIN).withColumn("_mark", F.lit(True))
    hot = "_mark IS NOT NULL"
    return (
        of_blocs(of_years(flows, years), blocs)
        .select(*KEYS, "origin_id", "volume", "ha_def")
        .join(marks, list(ORIGIN), "left")
        .groupBy(*KEYS)
        .agg(
            r_round(strict_sum("volume", hot) * units.mass, 6).alias("mass"),
            r_round(nz_sum(f"CASE WHEN {hot} THEN ha_def END")).alias("ha_def"),
            distinct_with_missing("origin_id", hot).alias("n_origins"),
            r_round(nz_sum("ha_def")).alias("cleared_total"),
            F.count("_mark").alias("_hot"),
        )
        .where("_hot > 0")
        .drop("_hot")
        .withColumn("pct_cleared", r_round(percent("ha_def", "cleared_total")))
        .orderBy(descending(F.col("product")), ascending(F.col("year")), "bloc")
    )


def origin_counts(flows: DataFrame, blocs: Sequence[str]) -> DataFrame:
    """Distinct origins per year, bloc and product; an unnamed origin counts once."""
    return (
        of_blocs(flows, blocs)
        .groupBy(*KEYS)
        .agg(distinct_with_missing("origin_id").alias("n_origins"))
    )
