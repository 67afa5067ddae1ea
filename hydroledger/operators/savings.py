"""Water saved if every origin above the cutoff performed at the median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ascending, descending, nz_sum, percent, r_round, signif_sql
from ..plans.lookups import bound, lookup, require_unique
from .model import ABOVE_WF, NATIONAL, PRODUCTS, Units, by_product, by_product_sql, of_years
from .ordered import exact_median
from .summary import KEYS, of_blocs


def median_footprint(production: DataFrame) -> DataFrame:
    """Unweighted exact median coefficient per year and product.

    Crop: total water; herd: blue water.  Zero and missing coefficients are left out.
    """
    coefficient = by_product(F.col("wf"), F.col("bwf"))
    used = production.select("year", "product", coefficient.alias("coef")).where("coef != 0")
    return exact_median(used, ["year", "product"], "coef", "median")


def tagged_origins(
    bench: DataFrame, years: Sequence[str], products: Sequence[str] = PRODUCTS
) -> DataFrame:
    """Product and id of the origins above the cutoff in any of the years.

    No flow of another origin takes part in the savings, so a scan may leave them out.
    """
    tagged = of_years(bench, years).where(F.col("tag_wf") == ABOVE_WF)
    return tagged.where(F.col("product").isin(*products)).select("product", "origin_id").distinct()


def median_savings(
    flows: DataFrame,
    bench: DataFrame,
    medians: DataFrame,
    blocs: Sequence[str],
    years: Sequence[str],
    products: Sequence[str] = PRODUCTS,
    units: Units = NATIONAL,
) -> DataFrame:
    """Actual and median-performance water of the flows tagged above the cutoff.

    Crop flows are cut to four significant digits each and their sums rounded; herd
    flows are neither.  All years, blocs and products run as one grouped query.  A
    ``copies`` column in the flows says how many equal flows a row stands for.  The
    coefficients ``wf`` and ``bwf`` are the flows' own where they carry both, else
    those of the benchmark table.  An origin that is tagged twice fails the job.
    """
    copies = "copies" if "copies" in flows.columns else None
    own = {"wf", "bwf"} <= set(flows.columns)
    coefficient = by_product(F.col("wf"), F.col("bwf")).alias("coef")
    tagged = bench.where(F.col("tag_wf") == ABOVE_WF).select(
        "year", "product", "origin_id", *([] if own else [coefficient])
    )
    tagged = of_years(tagged, years).where(F.col("product").isin(*products))
    tagged = require_unique(tagged, ["year", "product", "origin_id"])
    middle = of_years(medians, years).where(F.col("product").isin(*products))
    middle = lookup(middle, bound(years, products))
    at_median, as_is = [
        nz_sum(by_product_sql(signif_sql(water, 4), water), copies) * units.water
        for water in ("(median * volume)", "(coef * volume)")
    ]
    return (
        of_blocs(of_years(flows, years), blocs)
        .where(F.col("product").isin(*products))
        .select(
            *KEYS,
            "origin_id",
            "volume",
            *([copies] if copies else []),
            *([coefficient] if own else []),
        )
        .join(tagged, ["year", "product", "origin_id"])
        .join(middle, ["year", "product"], "left")
        .groupBy(*KEYS, "median")
        .agg(at_median.alias("at_median"), as_is.alias("as_is"))
        .withColumn("at_median", by_product(r_round("at_median", 2), F.col("at_median")))
        .withColumn("as_is", by_product(r_round("as_is", 2), F.col("as_is")))
        .select(
            "bloc",
            "at_median",
            "as_is",
            "median",
            r_round("as_is - at_median", 2).alias("savings"),
            "year",
            "product",
        )
    )


def savings_table(
    savings: DataFrame, crop_footprint: DataFrame, herd_footprint: DataFrame, domestic: str
) -> DataFrame:
    """Savings beside the water they are measured against, as a percentage."""
    reference = crop_footprint.select(
        *KEYS, "water", F.lit("green + blue").alias("type")
    ).unionByName(
        herd_footprint.select(*KEYS, F.col("blue").alias("water"), F.lit("blue only").alias("type"))
    )
    return (
        savings.join(reference.where(F.col("bloc") != domestic), list(KEYS), "left")
        .withColumn("pct_savings", r_round(percent("savings", "water")))
        .orderBy(ascending(F.col("bloc")), descending(F.col("product")), ascending(F.col("year")))
        .select(
            "bloc",
            "at_median",
            "as_is",
            "median",
            "savings",
            "year",
            "product",
            "water",
            "type",
            "pct_savings",
        )
    )

