"""The catalog's results as plain SQL over the same tables.

Written from the definitions of the tables, not from the Spark plans: no staging,
no pre-aggregation, plain windows and medians, decimal sums; amounts that come
from a quotient are added up as their shortest decimals.
"""

from __future__ import annotations

from ..operators import residual
from ..operators.model import (
    ABOVE_DEF,
    ABOVE_WF,
    ABOVE_WSF,
    BELOW_DEF,
    BELOW_WF,
    BELOW_WSF,
    CROP,
    DOMESTIC,
    HERD,
    IRRIGATED,
    RAINFED,
)
from ..operators.tail import CUT
from ..sources.star import FOREIGN, HOME, IMPORTERS, YEARS
from .catalog import MAP_YEAR, UNKNOWN


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_IMPORTERS, _YEARS = _list(IMPORTERS), _list(YEARS)
_FOREIGN, _WITH_HOME = _list(FOREIGN), _list((*IMPORTERS, HOME))


def _total(x: str) -> str:
    """Sum of decimals as a double, zero when there is nothing to add."""
    return f"coalesce(cast(sum({x}) AS double), 0)"


def _exact(x: str, places: int = 18) -> str:
    """Sum of doubles, each as its shortest decimal, missing when there is nothing to add."""
    return f"cast(cast(sum(cast(cast({x} AS varchar) AS decimal(38,{places}))) AS varchar) AS double)"


def _added(x: str, places: int = 18) -> str:
    """The same sum, zero when there is nothing to add."""
    return f"coalesce({_exact(x, places)}, 0)"


def _strict(x: str, digits: int = 6) -> str:
    """Sum of doubles with few decimals; missing if any is missing."""
    return (
        f"CASE WHEN count({x}) = count(*) "
        f"THEN cast(sum(cast({x} AS decimal(18,{digits}))) AS double) END"
    )


def _signif(x: str, digits: int) -> str:
    shift = f"({digits - 1} - floor(log10(abs({x}))))"
    return (
        f"CASE WHEN {x} = 0 THEN 0.0 "
        f"WHEN {shift} >= 0 THEN round_even({x} * pow(10, {shift}), 0) / pow(10, {shift}) "
        f"ELSE round_even({x} / pow(10, -{shift}), 0) * pow(10, -{shift}) END"
    )


def _flows(where: str = "true") -> str:
    return f"""trade AS (
  SELECT cast(year(o_orderdate) AS varchar) AS year, r_name AS bloc,
    CASE WHEN l_linestatus = 'O' THEN '{CROP}' ELSE '{HERD}' END AS product,
    CASE WHEN l_suppkey % 10 = 9 THEN 'AGGREGATED-' || s_nationkey
         ELSE 'M-' || l_suppkey END AS origin_id,
    CASE WHEN l_suppkey % 10 = 9 THEN 'AGGREGATED' ELSE s_name END AS name,
    sn.n_name AS state, 'N' || s_nationkey AS state_abbr, s_nationkey AS state_code,
    CASE WHEN l_suppkey % 10 <> 9 THEN 'BASIN_' || s_nationkey END AS basin,
    cast(l_quantity AS decimal(18,2)) AS volume,
    cast(l_extendedprice AS decimal(18,2)) AS green_m3,
    CASE WHEN l_suppkey % 3 = 0 THEN cast(0 AS decimal(24,4))
         ELSE cast(cast(l_extendedprice AS decimal(18,2))
                   * cast(l_discount AS decimal(4,2)) AS decimal(24,4)) END AS blue_m3,
    cast(cast(l_quantity AS decimal(18,2))
         * cast(nullif(l_tax, 0) AS decimal(4,2)) AS decimal(24,4)) AS ha_def,
    cast(cast(l_quantity AS decimal(18,2))
         * cast(l_discount AS decimal(4,2)) AS decimal(24,4)) AS co2_def,
    CASE WHEN l_suppkey % 10 = 9 THEN NULL WHEN l_suppkey % 3 = 0 THEN 0.0
         ELSE cast((l_suppkey % 97 + 1) * 1.5 AS double) END AS bwf,
    CASE WHEN l_suppkey % 10 <> 9 THEN cast((l_suppkey % 53 + 1) * 20 AS double)
      + CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE (l_suppkey % 97 + 1) * 1.5 END END AS wf,
    CASE WHEN l_suppkey % 10 = 9 THEN NULL WHEN l_suppkey % 3 = 0 THEN 0.0
         ELSE abs(s_acctbal) END AS bwsf
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN region ON cn.n_regionkey = r_regionkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
  WHERE {where})"""


_TRADE = _flows()
_BULK = _flows("l_quantity >= 50 AND (l_suppkey % 3 = 0 OR l_extendedprice * l_discount = 0)")


def _produced(where: str = "true") -> str:
    return f"""prod_sums AS (
  SELECT cast(year(o_orderdate) AS varchar) AS year,
    CASE WHEN l_linestatus = 'O' THEN '{CROP}' ELSE '{HERD}' END AS product, l_suppkey,
    cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS tonnes,
    cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS pasture_m3,
    cast(sum(cast(l_extendedprice AS decimal(18,2)) * cast(l_discount AS decimal(4,2)))
         AS double) AS blue_all,
    cast(sum(cast(l_quantity AS decimal(18,2)) * cast(l_tax AS decimal(4,2))) AS double) AS def_ha,
    cast(sum(cast(l_quantity AS decimal(18,2)) * cast(l_discount AS decimal(4,2)))
         AS double) AS ghg_t,
    count(*) AS n_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE {where} GROUP BY 1, 2, 3),
prod AS (
  SELECT year, product, 'M-' || l_suppkey AS origin_id, s_nationkey AS state_code,
    tonnes, pasture_m3, def_ha, ghg_t, pasture_m3 / tonnes AS gwf,
    CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE blue_all / tonnes END AS bwf,
    pasture_m3 / tonnes + CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE blue_all / tonnes END AS wf,
    CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE abs(s_acctbal) END AS bwsf,
    def_ha / tonnes AS def_per_t, ghg_t / tonnes AS co2_per_t,
    (ghg_t / tonnes) * 0.5 AS co2_low_per_t, (ghg_t / tonnes) * 1.5 AS co2_high_per_t,
    tonnes * 0.5 AS planted_ha,
    CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE ghg_t END AS irrigated_ha,
    tonnes * 1000 AS live_kg, tonnes * 2 AS pasture_ha,
    CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE blue_all END AS animal_m3,
    pasture_m3 * 0.25 AS reservoir_m3, tonnes * 0.125 AS water_ha,
    ghg_t * 1500 AS co2_high_kg, ghg_t * 500 AS co2_low_kg,
    CASE WHEN n_lines > 1 THEN tonnes / n_lines END AS stock
  FROM prod_sums LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


_PROD = _produced()
_PROD_BULK = _produced("l_quantity >= 50 AND l_returnflag = 'R'")

_MEAN = _exact("{c}") + " / count({c})"
_BENCH = f"""cutoffs AS (
  SELECT year, product, {_MEAN.format(c="bwf")} AS cut_wf, {_MEAN.format(c="bwsf")} AS cut_wsf,
    {_MEAN.format(c="def_per_t")} AS cut_def FROM prod GROUP BY 1, 2),
bench AS (
  SELECT year, product, origin_id, wf, bwf,
    CASE WHEN bwf > cut_wf THEN '{ABOVE_WF}' ELSE '{BELOW_WF}' END AS tag_wf,
    CASE WHEN bwf <> 0 THEN '{IRRIGATED}' ELSE '{RAINFED}' END AS tag_irr,
    CASE WHEN def_per_t > cut_def THEN '{ABOVE_DEF}' ELSE '{BELOW_DEF}' END AS tag_def,
    CASE WHEN bwsf > cut_wsf THEN '{ABOVE_WSF}' ELSE '{BELOW_WSF}' END AS tag_wsf
  FROM prod JOIN cutoffs USING (year, product))"""

_PLACE = """place AS (
  SELECT 'M-' || s_suppkey AS origin_id,
    'POINT(' || s_nationkey || ' ' || s_suppkey || ')' AS geometry FROM supplier
  UNION ALL SELECT 'M-NODATA', 'POINT(-1 -1)')"""

_LABELS = """labels_ws AS (
  SELECT 'BASIN_' || n_nationkey AS basin,
    CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS scarcity
  FROM nation)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- totals -----------------------------------------------------------------

_SUMMARY = f"""crop_part AS (
  SELECT year, bloc, product, {_total("volume")} AS vol_total,
    {_total("CASE WHEN bwf IS NULL THEN NULL WHEN bwf = 0 THEN 0 ELSE volume END")}
      AS vol_irrigated,
    round_even({_total("green_m3")} * 1e-6, 1) AS green,
    round_even({_total("blue_m3")} * 1e-6, 2) AS blue,
    round_even({_total("ha_def")}, 0) AS cleared_total
  FROM trade WHERE product = '{CROP}' AND bloc IN {_IMPORTERS} GROUP BY 1, 2, 3),
herd_part AS (
  SELECT year, bloc, product, {_total("volume")} AS vol_total, cast(0 AS double) AS vol_irrigated,
    round_even({_total("green_m3")} * 1e-6, 0) AS green,
    round_even({_total("blue_m3")} * 1e-6, 2) AS blue,
    round_even({_total("ha_def")}, 0) AS cleared_total
  FROM trade WHERE product = '{HERD}' AND bloc IN {_IMPORTERS} GROUP BY 1, 2, 3),
summary AS (
  SELECT year, bloc, product, vol_total, vol_irrigated, green, blue,
    round_even(green + blue, 1) AS water, cleared_total
  FROM (SELECT * FROM crop_part UNION ALL SELECT * FROM herd_part))"""

_TOTALS = f"""totals AS (
  SELECT year, bloc, round_even({_strict("green")}, 0) AS green,
    round_even({_strict("blue")}, 2) AS blue, round_even({_strict("water")}, 0) AS water
  FROM summary GROUP BY 1, 2)"""

_CROP_FOOTPRINT = f"""crop_footprint AS (
  SELECT *, round_even(green + blue, 1) AS water FROM (
    SELECT year, bloc, product, round_even({_total("volume")} * 1e-3, 1) AS mass,
      round_even({_total("green_m3")} * 1e-6, 1) AS green,
      round_even({_total("blue_m3")} * 1e-6, 2) AS blue,
      round_even({_total("ha_def")} * 1e-3, 2) AS cleared,
      round_even({_total("co2_def")} * 1e-3, 0) AS co2_def
    FROM trade WHERE product = '{CROP}' AND bloc IN {_WITH_HOME} GROUP BY 1, 2, 3))"""

_HERD_FOOTPRINT = f"""herd_footprint AS (
  SELECT *, round_even(co2_def + co2_mean, 0) AS co2_total,
    round_even(green + blue, 1) AS water FROM (
    SELECT year, bloc, product, round_even({_total("volume")} * 1e-3, 3) AS mass,
      round_even({_total("green_m3")} * 1e-6, 0) AS green,
      round_even({_total("blue_m3")} * 1e-6, 2) AS blue,
      round_even({_total("ha_def")} * 1e-3, 3) AS cleared,
      round_even({_total("co2_def")} * 1e-3, 1) AS co2_def,
      (round_even({_total("co2_def * 0.5")} * 1e-3, 1)
       + round_even({_total("co2_def * 1.5")} * 1e-3, 1)) / 2 AS co2_mean
    FROM trade WHERE product = '{HERD}' AND bloc IN {_WITH_HOME} GROUP BY 1, 2, 3))"""

ORACLE: dict[str, str] = {
    "product_summary": _with(_TRADE, _SUMMARY, select="SELECT * FROM summary"),
    "bloc_totals": _with(_TRADE, _SUMMARY, _TOTALS, select="SELECT * FROM totals"),
    "crop_bloc_footprint": _with(_TRADE, _CROP_FOOTPRINT, select="SELECT * FROM crop_footprint"),
    "herd_bloc_footprint": _with(_TRADE, _HERD_FOOTPRINT, select="SELECT * FROM herd_footprint"),
    "import_totals": _with(
        _TRADE,
        select=f"""SELECT year, bloc, product, {_total("volume")} AS vol_total
FROM trade WHERE bloc IN {_IMPORTERS} GROUP BY 1, 2, 3""",
    ),
    "stored_footprint": _with(
        _TRADE,
        select=f"""SELECT year, bloc, product, {_total("volume")} AS vol_total
FROM trade WHERE bloc IN {_IMPORTERS} GROUP BY 1, 2, 3""",
    ),
    "irrigated_import_share": _with(
        _TRADE,
        f"""whole AS (SELECT year, bloc, {_total("volume")} AS vol_total FROM trade
  WHERE product = '{CROP}' AND bloc IN {_IMPORTERS} GROUP BY 1, 2),
part AS (SELECT year, bloc, {_total("volume")} AS vol_irrigated FROM trade
  WHERE product = '{CROP}' AND bloc IN {_IMPORTERS} AND bwsf <> 0 GROUP BY 1, 2)""",
        select="""SELECT year, bloc, vol_irrigated, vol_total,
  100 * vol_irrigated / nullif(vol_total, 0) AS pct_irrigated
FROM part LEFT JOIN whole USING (year, bloc)""",
    ),
    "origin_counts": _with(
        _TRADE,
        select=f"""SELECT year, bloc, product,
  count(DISTINCT coalesce(origin_id, '<none>')) AS n_origins
FROM trade WHERE bloc IN {_IMPORTERS} GROUP BY 1, 2, 3""",
    ),
}

# --- domestic residual ------------------------------------------------------

_PARTS = {
    "cleared": ("ha_def", "def_per_t"),
    "blue_m3": ("blue_m3", "bwf"),
    "green_m3": ("green_m3", "gwf"),
    "co2_high": ("co2_def * 1.5", "co2_high_per_t"),
    "co2_low": ("co2_def * 0.5", "co2_low_per_t"),
    "co2_def": ("co2_def", "co2_per_t"),
}


def _exports(blocs: str) -> str:
    sums = ", ".join(f"{_total(m)} AS {n}_out" for n, (m, _) in _PARTS.items())
    return f"""exports AS (
  SELECT year, state_code, {_total("volume")} AS volume_out, {sums}
  FROM trade WHERE product = '{HERD}' AND bloc IN {blocs} GROUP BY 1, 2)"""


_RESIDUAL = f"""made AS (
  SELECT year, state_code, {_added("tonnes")} AS produced,
    {", ".join(f"{_added(f'{c} * tonnes')} AS {n}_all" for n, (_, c) in _PARTS.items())}
  FROM prod WHERE product = '{HERD}' GROUP BY 1, 2),
residual AS (
  SELECT year, state_code, produced, produced - coalesce(volume_out, 0) AS volume,
    {", ".join(f"{n}_all - coalesce({n}_out, 0) AS {n}" for n in _PARTS)},
    '{DOMESTIC}' AS bloc
  FROM made LEFT JOIN exports USING (year, state_code))"""

_UNKNOWN = "unknown(year, unknown_t) AS (VALUES " + ", ".join(
    f"('{y}', cast({t} AS double))" for y, t in UNKNOWN.items()
) + ")"

ORACLE |= {
    "state_exports": _with(_TRADE, _exports(_FOREIGN), select="SELECT * FROM exports"),
    "state_domestic_residual": _with(
        _TRADE, _PROD, _exports(_FOREIGN), _RESIDUAL, select="SELECT * FROM residual"
    ),
    "state_domestic_residual_bulk": _with(
        _BULK, _PROD, _exports("('ASIA')"), _RESIDUAL, select="SELECT * FROM residual"
    ),
    "national_domestic_residual": _with(
        _TRADE,
        _PROD,
        _exports(_FOREIGN),
        _RESIDUAL,
        _UNKNOWN,
        f"""nation_year AS (
  SELECT year, round_even({_added("volume")} * 1e-3, 2) AS mass_all,
    round_even({_added("green_m3")} * 1e-6, 0) AS green,
    round_even({_added("blue_m3")} * 1e-6, 0) AS blue,
    round_even({_added("cleared")} * 1e-3, 2) AS cleared,
    round_even({_added("co2_def")} * 1e-3, 0) AS co2_def,
    round_even({_added("co2_high")} * 1e-3, 0) AS co2_high,
    round_even({_added("co2_low")} * 1e-3, 0) AS co2_low
  FROM residual GROUP BY 1)""",
        select="""SELECT year, round_even(mass_all - unknown_t * 1e-3, 2) AS mass, green, blue,
  round_even(green + blue, 1) AS water, cleared, co2_def, co2_high, co2_low,
  round_even((co2_low + co2_high) / 2, 0) AS co2_mean,
  round_even(co2_def + round_even((co2_low + co2_high) / 2, 0), 0) AS co2_total
FROM nation_year LEFT JOIN unknown USING (year)""",
    ),
}

# --- basins -----------------------------------------------------------------

_BASINS = f"""basin_part AS (
  SELECT year, bloc, product, basin,
    round_even({_total("green_m3")} * 1e-6, CASE product WHEN '{CROP}' THEN 1 ELSE 0 END) AS green,
    round_even({_total("blue_m3")} * 1e-6, 2) AS blue
  FROM trade WHERE bloc IN {_IMPORTERS}
    AND (product = '{CROP}' OR NOT contains(origin_id, 'AGGREGATED')) GROUP BY 1, 2, 3, 4),
basin_rows AS (
  SELECT b.year, b.bloc, b.basin, b.green, b.blue,
    round_even(b.green + b.blue, 1) AS water_basin, scarcity, t.water AS water_bloc,
    round_even(100 * round_even(b.green + b.blue, 1) / nullif(t.water, 0), 2) AS pct,
    t.blue AS blue_bloc
  FROM basin_part b
  LEFT JOIN labels_ws l ON b.basin IS NOT DISTINCT FROM l.basin
  LEFT JOIN totals t ON b.year = t.year AND b.bloc = t.bloc),
blue_rows AS (
  SELECT year, bloc, basin, blue AS blue_basin, scarcity, blue_bloc,
    round_even(100 * blue / nullif(blue_bloc, 0), 2) AS pct FROM basin_rows)"""
_BASIN_CTES = (_TRADE, _SUMMARY, _TOTALS, _LABELS, _BASINS)

ORACLE |= {
    "basin_footprint": _with(
        *_BASIN_CTES, select="SELECT * EXCLUDE (blue_bloc) FROM basin_rows"
    ),
    "basin_scarcity_rollup": _with(
        *_BASIN_CTES,
        select=f"""SELECT year, bloc, scarcity, {_strict("green")} AS green,
  {_strict("blue")} AS blue, {_strict("water_bloc")} AS water_bloc,
  round_even({_strict("pct")}, 0) AS pct FROM basin_rows GROUP BY 1, 2, 3""",
    ),
    "basin_blue_share": _with(*_BASIN_CTES, select="SELECT * FROM blue_rows"),
    "basin_blue_scarcity_rollup": _with(
        *_BASIN_CTES,
        select=f"""SELECT year, bloc, scarcity, {_strict("blue_basin")} AS blue,
  round_even({_strict("pct")}, 0) AS pct FROM blue_rows GROUP BY 1, 2, 3""",
    ),
}

# --- benchmarks and savings -------------------------------------------------

_MEDIANS = f"""medians AS (
  SELECT year, product, median(coef) AS median FROM (
    SELECT year, product, CASE product WHEN '{CROP}' THEN wf ELSE bwf END AS coef FROM prod)
  WHERE coef <> 0 GROUP BY 1, 2)"""


def _savings(own: str) -> str:
    """``own``: the table that gives the coefficients, flows (t) or benchmark (b)."""
    return f"""tagged AS (
  SELECT t.bloc, t.year, t.product, m.median, cast(t.volume AS double) AS volume,
    CASE t.product WHEN '{CROP}' THEN {own}.wf ELSE {own}.bwf END AS coef
  FROM trade t JOIN bench b USING (year, product, origin_id)
  LEFT JOIN medians m USING (year, product)
  WHERE t.bloc IN {_IMPORTERS} AND t.year IN {_YEARS} AND b.tag_wf = '{ABOVE_WF}'),
savings AS (
  SELECT bloc, at_median, as_is, median, round_even(as_is - at_median, 2) AS savings, year, product
  FROM (
    SELECT bloc, year, product, median,
      round_even({_added(_signif("(median * volume)", 4))} * 1e-6, 2) AS at_median,
      round_even({_added(_signif("(coef * volume)", 4))} * 1e-6, 2) AS as_is
    FROM tagged WHERE product = '{CROP}' GROUP BY 1, 2, 3, 4
    UNION ALL
    SELECT bloc, year, product, median, {_added("(median * volume)")} * 1e-6,
      {_added("(coef * volume)")} * 1e-6
    FROM tagged WHERE product = '{HERD}' GROUP BY 1, 2, 3, 4))"""


_SAVING_CTES = (_TRADE, _PROD, _BENCH, _MEDIANS, _savings("b"))
_OWN_CTES = (_TRADE, _PROD, _BENCH, _MEDIANS, _savings("t"))

ORACLE |= {
    "median_footprint": _with(_PROD, _MEDIANS, select="SELECT * FROM medians"),
    "median_savings_crop": _with(
        *_SAVING_CTES, select=f"SELECT * FROM savings WHERE product = '{CROP}'"
    ),
    "median_savings_herd": _with(
        *_SAVING_CTES, select=f"SELECT * FROM savings WHERE product = '{HERD}'"
    ),
    "median_savings_crop_own": _with(
        *_OWN_CTES, select=f"SELECT * FROM savings WHERE product = '{CROP}'"
    ),
    "median_savings_herd_own": _with(
        *_OWN_CTES, select=f"SELECT * FROM savings WHERE product = '{HERD}'"
    ),
    "savings_table": _with(
        *_SAVING_CTES,
        _CROP_FOOTPRINT,
        _HERD_FOOTPRINT,
        f"""measured AS (
  SELECT year, bloc, product, water, 'green + blue' AS type FROM crop_footprint
  WHERE bloc <> '{HOME}'
  UNION ALL
  SELECT year, bloc, product, blue, 'blue only' FROM herd_footprint WHERE bloc <> '{HOME}')""",
        select="""SELECT savings.*, water, type,
  round_even(100 * savings / nullif(water, 0), 0) AS pct_savings
FROM savings LEFT JOIN measured USING (year, bloc, product)""",
    ),
}

# --- tails and hotspots -----------------------------------------------------


def _tail(product: str, base: str, coefs: str = "bwsf") -> str:
    """Tail rows of one product: ``base`` is the reference volume per flow."""
    ranked = "AND bwsf <> 0" if product == CROP else ""
    return f"""tail_{product} AS (
  SELECT *, volume_cum / nullif(vol_base, 0) AS perc FROM (
    SELECT *, sum(volume) OVER (PARTITION BY year, bloc, product
      ORDER BY bwsf NULLS LAST, origin_id ROWS UNBOUNDED PRECEDING) AS volume_cum
    FROM (
      SELECT year, bloc, product, origin_id, {coefs}, {_total("volume")} AS volume,
        {_total("ha_def")} AS ha_def
      FROM trade WHERE product = '{product}' AND bloc IN {_IMPORTERS} AND year IN {_YEARS} {ranked}
      GROUP BY year, bloc, product, origin_id, {coefs}))
  JOIN (SELECT year, bloc, {_total(base)} AS vol_base FROM trade
        WHERE product = '{product}' GROUP BY 1, 2) USING (year, bloc)
  WHERE volume_cum / nullif(vol_base, 0) > {CUT} OR (vol_base = 0 AND volume_cum > 0))"""


_IRRIGATED_VOLUME = "CASE WHEN bwf IS NULL THEN NULL WHEN bwf = 0 THEN 0 ELSE volume END"
_TAILS = (_tail(CROP, _IRRIGATED_VOLUME), _tail(HERD, "volume"))
_TAIL_COLUMNS = (
    "year, bloc, product, origin_id, bwsf, volume, ha_def, volume_cum, vol_base, perc"
)
_LAYER_COLUMNS = "year, origin_id, bloc, volume, volume_cum, perc, bwf, bwsf"
_SCARCE_VOLUME = "CASE WHEN bwsf <> 0 THEN volume END"

_HOT = f"""hot AS (
  SELECT t.year, t.origin_id, t.bloc, t.product, cast(t.volume AS double) AS volume,
    cast(t.ha_def AS double) AS ha_def
  FROM trade t JOIN bench b USING (year, product, origin_id)
  WHERE t.bloc IN {_IMPORTERS} AND t.year IN {_YEARS} AND b.tag_def = '{ABOVE_DEF}'
    AND CASE t.product WHEN '{CROP}' THEN b.tag_irr = '{IRRIGATED}'
        ELSE b.tag_wsf = '{ABOVE_WSF}' END)"""

ORACLE |= {
    "tail_origins_crop": _with(
        _TRADE, *_TAILS, select=f"SELECT {_TAIL_COLUMNS} FROM tail_{CROP}"
    ),
    "tail_origins_herd": _with(
        _TRADE, *_TAILS, select=f"SELECT {_TAIL_COLUMNS} FROM tail_{HERD}"
    ),
    "tail_clearing_share": _with(
        _TRADE,
        _SUMMARY,
        *_TAILS,
        f"""tails AS (
  SELECT year, bloc, product, {_strict("volume")} * 1e-3 AS mass,
    round_even({_strict("ha_def")}, 0) AS ha_def
  FROM (SELECT {_TAIL_COLUMNS} FROM tail_{CROP} UNION ALL
        SELECT {_TAIL_COLUMNS} FROM tail_{HERD}) GROUP BY 1, 2, 3)""",
        select="""SELECT year, bloc, product, mass, ha_def, cleared_total,
  round_even(100 * ha_def / nullif(cleared_total, 0), 0) AS pct_cleared
FROM tails LEFT JOIN summary USING (year, bloc, product)""",
    ),
    "tail_layer_crop": _with(
        _TRADE,
        _PLACE,
        _tail(CROP, _SCARCE_VOLUME, "bwf, bwsf"),
        select=f"""SELECT {_LAYER_COLUMNS}, vol_base AS vol_irrigated, geometry
FROM tail_{CROP} JOIN place USING (origin_id)""",
    ),
    "tail_layer_herd": _with(
        _TRADE,
        _PLACE,
        _tail(HERD, "volume", "bwf, bwsf"),
        select=f"""SELECT {_LAYER_COLUMNS}, vol_base AS vol_total, geometry
FROM tail_{HERD} JOIN place USING (origin_id)""",
    ),
    "hotspot_origins_crop": _with(
        _TRADE, _PROD, _BENCH, _HOT, select=f"SELECT * FROM hot WHERE product = '{CROP}'"
    ),
    "hotspot_origins_herd": _with(
        _TRADE, _PROD, _BENCH, _HOT, select=f"SELECT * FROM hot WHERE product = '{HERD}'"
    ),
    "hotspot_clearing_share": _with(
        _TRADE,
        _SUMMARY,
        _PROD,
        _BENCH,
        _HOT,
        f"""hot_sums AS (
  SELECT year, bloc, product, round_even({_strict("volume")} * 1e-3, 6) AS mass,
    round_even({_added("ha_def")}, 0) AS ha_def,
    count(DISTINCT coalesce(origin_id, '<none>')) AS n_origins
  FROM hot GROUP BY 1, 2, 3)""",
        select="""SELECT year, bloc, product, mass, ha_def, n_origins, cleared_total,
  round_even(100 * ha_def / nullif(cleared_total, 0), 0) AS pct_cleared
FROM hot_sums LEFT JOIN summary USING (year, bloc, product)""",
    ),
}

# --- water series and panels ------------------------------------------------


# Fixed values in the SQL below: the four series, in the order of the published panels.
def _series(grain: str, blocs: str = f"bloc IN {_IMPORTERS}") -> str:
    return f"""series AS (
  SELECT {grain}, product || ' - ' || colour AS type,
    CASE product || ' - ' || colour WHEN 'Soy - Green' THEN 1 WHEN 'Beef - Green' THEN 2
      WHEN 'Soy - Blue' THEN 3 WHEN 'Beef - Blue' THEN 4 END AS type_rank,
    {_total("m3")} AS water_m3, {_total("m3")} * 1e-6 AS water
  FROM (SELECT *, 'Green' AS colour, cast(green_m3 AS decimal(24,4)) AS m3 FROM trade
        UNION ALL SELECT *, 'Blue', blue_m3 FROM trade)
  WHERE {blocs} AND m3 <> 0
  GROUP BY {grain}, product, colour)"""


_ORIGIN_SERIES = _series("year, origin_id, name, state, state_abbr, basin, bloc")
_LINKED = "NOT contains(origin_id, 'AGGREGATED')"
_BLUE = "type IN ('Soy - Blue', 'Beef - Blue')"
_ALL = "true"

_DOMAIN = "domain AS (SELECT DISTINCT basin FROM series WHERE basin IS NOT NULL)"
_GRID = f"""grid AS (
  SELECT year, bloc, basin FROM domain,
    (SELECT unnest([{", ".join(f"'{y}'" for y in YEARS)}]) AS year),
    (SELECT unnest([{", ".join(f"'{b}'" for b in IMPORTERS)}]) AS bloc))"""


def _panel(types: str = _ALL) -> str:
    return f"""shown AS (
  SELECT year, bloc, type, basin, {_added("water_m3")} * 1e-6 AS water
  FROM series WHERE {_LINKED} AND {types} AND year IN {_YEARS} GROUP BY 1, 2, 3, 4),
gaps AS (
  SELECT year, bloc, basin FROM grid g WHERE NOT EXISTS (
    SELECT 1 FROM shown s WHERE s.year = g.year AND s.bloc = g.bloc AND s.basin = g.basin)),
panel AS (
  SELECT year, bloc, type, basin, water FROM shown
  UNION ALL SELECT year, bloc, 'Beef - Blue', basin, cast(0 AS double) FROM gaps)"""


_ORDER = f"""axis_order AS (
  SELECT year, basin, cast(row_number() OVER (
    PARTITION BY year ORDER BY m3, basin NULLS LAST) AS integer) AS position
  FROM (
    SELECT year, basin, sum(m3) AS m3 FROM (
      SELECT year, basin, water_m3 AS m3 FROM series
      WHERE {_LINKED} AND year IN {_YEARS} AND bloc = '{IMPORTERS[0]}'
      UNION ALL SELECT year, basin, 0 FROM grid WHERE bloc = '{IMPORTERS[0]}')
    GROUP BY 1, 2))"""


def _panel_ctes(trade: str, types: str = _ALL, domain: str = _DOMAIN) -> tuple[str, ...]:
    return (trade, _ORIGIN_SERIES, domain, _GRID, _panel(types))


_LABELLED = """domain AS (
  SELECT 'BASIN_' || n_nationkey AS basin FROM nation UNION ALL SELECT 'BASIN_NODATA')"""
_ORDERED = """SELECT panel.*, position FROM panel LEFT JOIN axis_order o
ON panel.year = o.year AND panel.basin IS NOT DISTINCT FROM o.basin"""


_AXIS = f"""axis AS (
  SELECT year, basin, bloc, round_even({_added("water_m3")} * 1e-6, 2) AS water,
    'Green + Blue' AS label FROM series WHERE {_LINKED} GROUP BY 1, 2, 3
  UNION ALL
  SELECT year, basin, bloc, round_even({_added("water_m3")} * 1e-6, 2), 'Blue'
  FROM series WHERE {_LINKED} AND {_BLUE} GROUP BY 1, 2, 3)"""

ORACLE |= {
    "water_by_colour": _with(
        _TRADE,
        select=f"""SELECT year, bloc, product, colour, {_total("m3")} AS water_m3
FROM (SELECT year, bloc, product, 'Green' AS colour, cast(green_m3 AS decimal(24,4)) AS m3
      FROM trade
      UNION ALL SELECT year, bloc, product, 'Blue', blue_m3 FROM trade)
WHERE m3 <> 0 GROUP BY 1, 2, 3, 4""",
    ),
    "water_long": _with(_TRADE, _ORIGIN_SERIES, select="SELECT * FROM series"),
    "basin_axis_totals": _with(_TRADE, _ORIGIN_SERIES, _AXIS, select="SELECT * FROM axis"),
    "axis_max": _with(
        _TRADE,
        _ORIGIN_SERIES,
        _AXIS,
        select="SELECT label, max(water) AS axis_max FROM axis GROUP BY 1",
    ),
    "basin_domain": _with(_TRADE, _ORIGIN_SERIES, _DOMAIN, select="SELECT * FROM domain"),
    "panel_grid": _with(_TRADE, _ORIGIN_SERIES, _DOMAIN, _GRID, select="SELECT * FROM grid"),
    "basin_panel": _with(*_panel_ctes(_TRADE), select="SELECT * FROM panel"),
    "basin_panel_blue": _with(*_panel_ctes(_TRADE, _BLUE), select="SELECT * FROM panel"),
    "basin_panel_bulk": _with(*_panel_ctes(_BULK), select="SELECT * FROM panel"),
    "missing_basins": _with(
        *_panel_ctes(_TRADE, domain=_LABELLED), select="SELECT * FROM gaps"
    ),
    "ordered_panel": _with(
        *_panel_ctes(_TRADE, domain=_LABELLED), _ORDER, select=_ORDERED
    ),
    "missing_basins_bulk": _with(*_panel_ctes(_BULK), select="SELECT * FROM gaps"),
    "basin_order": _with(*_panel_ctes(_TRADE), _ORDER, select="SELECT * FROM axis_order"),
    "ordered_panel_bulk": _with(
        *_panel_ctes(_BULK),
        _ORDER,
        select=_ORDERED,
    ),
}

# --- map layers -------------------------------------------------------------


def _layer(prod: str, product: str, coef: str, classes: str, join: str = "FULL") -> str:
    return _with(
        prod,
        _PLACE,
        f"""made AS (
  SELECT origin_id, year, {coef} AS coef FROM prod WHERE product = '{product}'),
shown AS (
  SELECT origin_id, year, coef, geometry FROM made {join} JOIN place USING (origin_id)
  WHERE year IS NULL OR year = '{MAP_YEAR}')""",
        select=f"""SELECT origin_id, year, coef,
  CASE WHEN coef IS NULL OR coef = 0 THEN '0' {classes} END AS bin, geometry FROM shown""",
    )


# Class edges and labels of the published maps.
_SCARCITY = """WHEN coef > 0 AND coef < 500 THEN '0-500' WHEN coef >= 500 AND coef < 1000
  THEN '500-1000' WHEN coef >= 1000 AND coef < 2000 THEN '1000-2000' WHEN coef >= 2000
  AND coef < 3000 THEN '2000-3000' WHEN coef >= 3000 AND coef < 5000 THEN '3000-5000'
  WHEN coef >= 5000 THEN '> 5000'"""
_HERD_SCARCITY = """WHEN coef > 0 AND coef < 10000 THEN '0-10k' WHEN coef >= 10000 AND coef < 50000
  THEN '10-50k' WHEN coef >= 50000 AND coef < 100000 THEN '50-100k' WHEN coef >= 100000
  THEN '>100k'"""
_WATER = """WHEN coef > 0 AND coef < 1000 THEN '0-1000' WHEN coef >= 1000 AND coef < 2000
  THEN '1000-2000' WHEN coef >= 2000 AND coef < 3000 THEN '2000-3000' WHEN coef >= 3000
  THEN '> 3000'"""
_CROP_BLUE = """WHEN coef > 0 AND coef < 100 THEN '0-100' WHEN coef >= 100 AND coef < 250
  THEN '100-250' WHEN coef >= 250 AND coef < 500 THEN '250-500' WHEN coef >= 500
  AND coef < 1000 THEN '500-1000' WHEN coef >= 1000 THEN '>1000'"""
_HERD_BLUE = """WHEN coef > 0 AND coef < 250 THEN '0-250' WHEN coef >= 250 AND coef < 500
  THEN '250-500' WHEN coef >= 500 AND coef < 1000 THEN '500-1000' WHEN coef >= 1000
  THEN '> 1000'"""
_PASTURE = """WHEN coef > 0 AND coef < 1000 THEN '0-1000' WHEN coef >= 1000 AND coef < 5000
  THEN '1000-5000' WHEN coef >= 5000 AND coef < 10000 THEN '5000-10,000' WHEN coef >= 10000
  AND coef < 20000 THEN '10,000-20,000' WHEN coef >= 20000 THEN '> 20,000'"""


def _classes(product: str, second: str) -> str:
    def sheet(clearing: str) -> str:
        return f"""SELECT origin_id, year, tag, geometry, '{clearing}' AS clearing
FROM (SELECT origin_id, year, coalesce(tag_wf, 'NA') || ', ' || coalesce({second}, 'NA') AS tag
      FROM bench WHERE product = '{product}' AND year = '{MAP_YEAR}' AND tag_def = '{clearing}')
FULL JOIN place USING (origin_id)"""

    return _with(
        _PROD, _BENCH, _PLACE, select=f"{sheet(BELOW_DEF)}\nUNION ALL\n{sheet(ABOVE_DEF)}"
    )


ORACLE |= {
    # Fixed values in it: class edges and labels of the published map.
    "blue_map_layer": _with(
        _TRADE,
        _PLACE,
        _ORIGIN_SERIES,
        f"""per_origin AS (
  SELECT year, bloc, origin_id, {_added("water_m3")} * 1e-6 AS water
  FROM series WHERE {_LINKED} AND {_BLUE} AND year IN {_YEARS} GROUP BY 1, 2, 3)""",
        select="""SELECT year, bloc, origin_id, water,
  CASE WHEN water > 0 AND water < 1e-6 THEN '0-10^-6'
    WHEN water >= 1e-6 AND water < 1e-4 THEN '10^-6-10^-4'
    WHEN water >= 1e-4 AND water < 1e-2 THEN '10^-4-10^-2'
    WHEN water >= 1e-2 THEN '>10^-2' END AS bin, geometry
FROM per_origin LEFT JOIN place USING (origin_id)""",
    ),
    "crop_scarcity_bins": _layer(_PROD, CROP, "bwsf", _SCARCITY, "INNER"),
    "herd_scarcity_bins": _layer(_PROD, HERD, "bwsf", _HERD_SCARCITY),
    "crop_water_bins": _layer(_PROD, CROP, "nullif(wf, 0)", _WATER),
    "crop_blue_bins": _layer(_PROD, CROP, "bwf", _CROP_BLUE),
    "herd_blue_bins": _layer(_PROD, HERD, "bwf", _HERD_BLUE),
    "herd_pasture_bins": _layer(_PROD, HERD, "gwf", _PASTURE),
    "crop_scarcity_bins_bulk": _layer(_PROD_BULK, CROP, "bwsf", _SCARCITY, "INNER"),
    "herd_blue_bins_bulk": _layer(_PROD_BULK, HERD, "bwf", _HERD_BLUE),
    "crop_bench_classes": _classes(CROP, "tag_irr"),
    "herd_bench_classes": _classes(HERD, "tag_wsf"),
}

# --- national production ----------------------------------------------------

_CROP_TOTALS = f"""crop_year AS (
  SELECT year, round_even({_added("tonnes")} * 1e-3, 1) AS mass,
    round_even({_added("planted_ha")} * 1e-3, 1) AS planted,
    round_even({_added("def_ha")} * 1e-3, 2) AS cleared,
    round_even({_added("ghg_t")} * 1e-3, 0) AS co2,
    round_even({_added("wf * tonnes")} * 1e-6, 0) AS water,
    round_even({_added("gwf * tonnes")} * 1e-6, 0) AS green,
    round_even({_added(_signif("(bwf * tonnes)", 4))} * 1e-6, 2) AS blue,
    round_even({_added("irrigated_ha")} * 1e-3, 2) AS irrigated
  FROM prod WHERE product = '{CROP}' GROUP BY 1)"""
_HERD_TOTALS = f"""herd_year AS (
  SELECT year, round_even({_added("live_kg")} * 1e-6, 1) AS mass,
    round_even({_added("pasture_ha")} * 1e-3, 0) AS pasture,
    round_even({_added("def_ha")} * 1e-3, 1) AS cleared,
    round_even({_added("ghg_t")} * 1e-3, 0) AS co2_def,
    round_even({_added("co2_high_kg")} * 1e-6, 0) AS co2_high,
    round_even({_added("co2_low_kg")} * 1e-6, 0) AS co2_low,
    round_even({_added("pasture_m3")} * 1e-6, 0) AS pasture_water,
    round_even({_added("animal_m3")} * 1e-6, 1) AS animal_water,
    round_even({_added("reservoir_m3")} * 1e-6, 1) AS reservoir_water,
    round_even({_added("round_even(water_ha, 0)")} * 1e-3, 2) AS water_area,
    round_even({_MEAN.format(c="stock")}, 2) AS stock_mean
  FROM prod WHERE product = '{HERD}' AND year IN {_YEARS} GROUP BY 1)"""


def _per(x: str) -> str:
    return f"({x} * 1e9 / nullif(mass * 1e6, 0))"


ORACLE |= {
    "crop_production_summary": _with(
        _PROD,
        _CROP_TOTALS,
        select=f"""SELECT *, round_even(100 * blue_per_t / nullif(water_per_t, 0), 2) AS pct_blue
FROM (SELECT *, round_even(mass * 1e6 / nullif(planted * 1e6, 0), 2) AS yield,
  {_signif("(cleared / nullif(mass * 1e-3, 0))", 2)} AS cleared_per_kt,
  {_signif("(co2 / nullif(mass, 0))", 2)} AS co2_per_t,
  round_even({_per("water")}, 0) AS water_per_t, round_even({_per("green")}, 0) AS green_per_t,
  round_even({_per("blue")}, 0) AS blue_per_t FROM crop_year)""",
    ),
    "herd_production_summary": _with(
        _PROD,
        _HERD_TOTALS,
        select=f"""SELECT *, {_signif("(cleared / nullif(mass * 1e-3, 0))", 3)} AS cleared_per_kt,
  round_even(co2_def / nullif(mass, 0), 1) AS co2_def_per_t,
  round_even(co2_low / nullif(mass, 0), 1) AS co2_low_per_t,
  round_even(co2_high / nullif(mass, 0), 1) AS co2_high_per_t,
  {_signif(_per("pasture_water"), 3)} AS pasture_per_t,
  round_even({_per("animal_water")}, 0) AS animal_per_t,
  round_even({_per("reservoir_water")}, 0) AS reservoir_per_t FROM herd_year""",
    ),
}

assert residual.RESIDUALS.keys() == _PARTS.keys()
