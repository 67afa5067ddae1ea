"""Origins in the upper tail of the running share of imports.

Origins of a (year, bloc, product) are ordered by their scarcity coefficient; the
tail is where the running volume exceeds a share of the reference volume.  Where
the reference volume is zero, every positive running volume does, and the share is missing.
Missing coefficients come last, so those origins count as tail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nz_exact_sum, nz_sum, percent, r_round, ratio, strict_sum
from .model import CROP, NATIONAL, PRODUCTS, Units, by_product_sql, of_years
from .ordered import range_parts, running_total
from .summary import KEYS, irrigated_volume, of_blocs

CUT = 0.8


def _ranked_origins(
    flows: DataFrame,
    blocs: Sequence[str],
    years: Sequence[str] | None,
    products: Sequence[str],
    cut: float,
    crop_base: str,
    coefficients: Sequence[str],
) -> DataFrame:
    """Tail origins with the reference volume and the clearing of their group.

    Flows are added up to one row per origin first.  Crop origins with a zero or
    missing scarcity coefficient stay in the written table with no weight: they
    belong to the totals, not to the order.
    """
    per_origin = (
        of_blocs(of_years(flows, years), blocs)
        .where(F.col("product").isin(*products))
        .groupBy(*KEYS, "origin_id", *coefficients)
        .agg(
            nz_exact_sum("volume").alias("volume"),
            nz_exact_sum("ha_def").alias("ha_def"),
            nz_exact_sum(by_product_sql(crop_base, "volume")).alias("_base"),
        )
        .withColumn("_ranked", F.expr(by_product_sql("coalesce(bwsf != 0, false)", "true")))
        .withColumn("_weight", F.expr("CASE WHEN _ranked THEN volume ELSE 0BD END"))
    )
    parts = range_parts(per_origin, KEYS, ["bwsf", "origin_id"])
    groups = parts.groupBy(*KEYS).agg(
        nz_sum("_base").alias("base"), nz_sum("ha_def").alias("cleared_group")
    )

    def beyond(running: Column) -> Column:
        """Above the cut; any volume is more than every share of a zero base."""
        base = F.col("base")
        return (ratio(running, base) > cut) | ((base == 0) & (running > 0))

    def may_hold_tail(before: Column, reach: Column) -> Column:
        return beyond(reach)

    return (
        running_total(
            parts,
            KEYS,
            ["bwsf", "origin_id"],
            "_weight",
            "volume_cum",
            groups=groups,
            keep=may_hold_tail,
        )
        .where("_ranked")
        .withColumn("perc", ratio(F.col("volume_cum"), F.col("base")))
        .where(beyond(F.col("volume_cum")))
        .withColumn("volume", F.col("volume").cast("double"))
        .withColumn("ha_def", F.col("ha_def").cast("double"))
    )


def tail_origins(
    flows: DataFrame,
    blocs: Sequence[str],
    years: Sequence[str],
    products: Sequence[str] = PRODUCTS,
    cut: float = CUT,
) -> DataFrame:
    """Tail origins per year, bloc and product.

    Crop: origins with a scarcity coefficient, against the irrigated volume.
    Herd: all origins, against the whole volume.
    """
    return _tail_rows(flows, blocs, years, products, cut).drop("cleared_group")


def _tail_rows(flows, blocs, years, products, cut) -> DataFrame:
    return _ranked_origins(
        flows, blocs, years, products, cut, irrigated_volume(), ["bwsf"]
    ).select(
        *KEYS,
        "origin_id",
        "bwsf",
        "volume",
        "ha_def",
        "volume_cum",
        F.col("base").alias("vol_base"),
        "perc",
        "cleared_group",
    )


def tail_clearing_share(
    flows: DataFrame,
    blocs: Sequence[str],
    years: Sequence[str],
    cut: float = CUT,
    units: Units = NATIONAL,
) -> DataFrame:
    """Clearing of the tail origins as a share of all clearing of their group."""
    return (
        _tail_rows(flows, blocs, years, PRODUCTS, cut)
        .groupBy(*KEYS)
        .agg(
            (strict_sum("volume") * units.mass).alias("mass"),
            r_round(strict_sum("ha_def")).alias("ha_def"),
            r_round(F.max("cleared_group")).alias("cleared_total"),
        )
        .withColumn("pct_cleared", r_round(percent("ha_def", "cleared_total")))
    )


def tail_layer(
    flows: DataFrame,
    place: DataFrame,
    product: str,
    blocs: Sequence[str],
    years: Sequence[str],
    cut: float = CUT,
) -> DataFrame:
    """Tail origins with their geometry, for a map.

    The crop share is taken against the volume with a scarcity coefficient, the same
    rows that are ranked; the herd share against the whole volume.  Origins without
    a place drop out.
    """
    scarce = "CASE WHEN bwsf != 0 THEN volume END"
    base = "vol_irrigated" if product == CROP else "vol_total"
    tail = _ranked_origins(flows, blocs, years, [product], cut, scarce, ["bwf", "bwsf"])
    return tail.join(place.select("origin_id", "geometry"), "origin_id").select(
        "year",
        "origin_id",
        "bloc",
        "volume",
        "volume_cum",
        "perc",
        "bwf",
        "bwsf",
        F.col("base").alias(base),
        "geometry",
    )

