"""Landscape algebra over the pixel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid import Grid
from firegrid.operators import algebra, focal, rasterize, synthetic, treatment
from firegrid.sources import tables as src

from .registry import query, r6
from .views import CELL

# A surface-effects table made from a rule over the fuel codes (one scenario "Manage").
SURFACE = """SELECT 'Manage' AS scenario, code AS fbfm40,
  CASE WHEN code % 10 >= 5 THEN code - 2 ELSE 101 END AS new_fbfm40
FROM (SELECT DISTINCT CAST(fbfm40 AS INT) AS code FROM {px} WHERE fbfm40 BETWEEN 101 AND 189) c"""


def surface_table(t):
    code = F.col("fbfm40").cast("int")
    return t.px.where(F.col("fbfm40").between(101, 189)).select(
        F.lit("Manage").alias("scenario"), code.alias("fbfm40"),
        F.when(code % 10 >= 5, code - 2).otherwise(101).alias("new_fbfm40"),
    ).distinct()


LONG_BANDS = ("slpd", "cc", "ch")


def long_bands(t):
    return t.px.select(
        F.lit("r1").alias("raster_id"), "row", "col",
        F.posexplode(F.array(*[F.struct(F.lit(f"LC20_{b.upper()}").alias("band"),
                                        F.col(b).cast("double").alias("value")) for b in LONG_BANDS]))
        .alias("band_index", "_b"),
    ).select("raster_id", "band_index", "_b.band", "row", "col", "_b.value")


@query("P1", "SELECT row, col, CAST(cc AS DOUBLE) AS value FROM {px}")
def band_by_exact_name(t):
    return algebra.select_band(long_bands(t), "LC20_CC").select("row", "col", "value")


@query("P2", "SELECT 'LC20_CH' AS band, row, col, CAST(ch AS DOUBLE) AS value FROM {px}")
def band_by_partial_name(t):
    px = long_bands(t)
    bands = px.select("raster_id", "band_index", "band").distinct()
    return algebra.find_band(bands, px, "ch").select("band", "row", "col", "value")


@query(
    "P3",
    "SELECT row, col, CAST(slpd AS DOUBLE) AS SLPD, CAST(cc AS DOUBLE) AS CC, CAST(ch AS DOUBLE) AS CH FROM {px}",
)
def stacked_bands(t):
    files = long_bands(t).withColumnRenamed("band", "file")
    return algebra.stack_bands(files, ["SLPD", "CC", "CH"]).drop("raster_id")


@query(
    "P4",
    "SELECT pix, CASE WHEN asp <> -1 THEN CAST(asp AS DOUBLE) END AS asp, flamelength FROM {px}",
)
def nodata_as_missing(t):
    px = t.px.select("pix", F.col("asp").cast("double").alias("asp"),
                     F.coalesce("flamelength", F.lit(float("nan"))).alias("flamelength"))
    return algebra.nodata_to_null(px, ["asp", "flamelength"], -1.0)


@query(
    "P5",
    """SELECT pix, round(CASE WHEN evt = 7050 THEN cbh * 0.7 ELSE cbh END, 6)::DOUBLE AS cbh,
  CASE WHEN evt = 7050 THEN 185 ELSE fbfm40 END AS fbfm40 FROM {px}""",
)
def vegetation_edit(t):
    return r6(algebra.adjust_by_evt(t.px).select("pix", "cbh", "fbfm40"))


RULES = [
    {"conditions": [("evt", "EQ", 7050), ("cbd", "EQ", 10)],
     "changes": [("cbh", "MB", 0.7), ("fbfm40", "ST", 185)]},
    {"conditions": [("fbfm40", "EQ", 185)], "changes": [("cc", "MB", 0.5), ("fbfm40", "ST", 183)]},
]


@query(
    "P6",
    """SELECT pix, round(CASE WHEN evt = 7050 AND cbd = 10 THEN cbh * 0.7 ELSE cbh END, 6)::DOUBLE AS cbh,
  CASE WHEN f = 185 THEN cc * 0.5 ELSE cc END::DOUBLE AS cc,
  CASE WHEN f = 185 THEN 183 ELSE f END::DOUBLE AS fbfm40
FROM (SELECT *, CASE WHEN evt = 7050 AND cbd = 10 THEN 185 ELSE fbfm40 END AS f FROM {px})""",
)
def edit_rules(t):
    return r6(algebra.apply_edit_rules(t.px, RULES).select("pix", "cbh", "cc", "fbfm40"))


@query(
    "P7 J14",
    """SELECT pix, CAST(coalesce(s.new_fbfm40, c) AS SMALLINT) AS fbfm40
FROM (SELECT pix, greatest(0, least(fbfm40, (SELECT max(fbfm40) FROM {surface}))) AS c FROM {px})
LEFT JOIN {surface} s ON s.fbfm40 = c""",
    surface=SURFACE,
)
def surface_remap(t):
    return treatment.remap_surface(t.px, surface_table(t), "Manage").select("pix", "fbfm40")


def _treated_sql(mask: str) -> str:
    def band(b: str, factor: float) -> str:
        return (
            f"CAST(CASE WHEN NOT ({mask}) THEN {b} WHEN floor(cc * 0.6::DOUBLE) >= 10 THEN "
            f"floor({b} * {factor}::DOUBLE) WHEN floor(cc * 0.6::DOUBLE) < 10 THEN 0 END AS SMALLINT) AS {b}"
        )

    fuel = "CAST(CASE WHEN NOT ({m}) THEN p.fbfm40 ELSE coalesce(s.new_fbfm40, c) END AS SMALLINT) AS fbfm40"
    return f"""SELECT pix, {band('cc', 0.6)}, {band('ch', 1.3)}, {band('cbh', 1.3)}, {band('cbd', 0.6)},
  {fuel.replace('{m}', mask)}
FROM (SELECT *, greatest(0, least(fbfm40, (SELECT max(fbfm40) FROM {{surface}}))) AS c FROM {{px}}) p
LEFT JOIN {{surface}} s ON s.fbfm40 = c"""


@query("P8 J1 J4", _treated_sql("true").replace("cc * 0.6", "cc * 0.6"), surface=SURFACE)
def treated_landscape(t):
    out = treatment.apply_treatment(
        t.px, src.canopy_effects(t.spark), surface_table(t), "Mech Thin", "Manage"
    )
    return out.select("pix", "cc", "ch", "cbh", "cbd", "fbfm40")


@query("P8", _treated_sql("evt = 7050"), surface=SURFACE)
def treated_landscape_masked(t):
    out = treatment.apply_treatment(
        t.px, src.canopy_effects(t.spark), surface_table(t), "Mech Thin", "Manage",
        mask=F.col("evt") == 7050,
    )
    return out.select("pix", "cc", "ch", "cbh", "cbd", "fbfm40")


@query(
    "P9 F35",
    """SELECT concat('s', p_partkey) AS raster_id, CAST(i // 3 AS INT) AS row, CAST(i % 3 AS INT) AS col,
  CAST(round_even(p_retailprice, 0) AS SMALLINT) AS elev,
  CAST(round_even(degrees(atan(p_size / 100.0::DOUBLE)), 0) AS SMALLINT) AS slpd, (-1)::SMALLINT AS asp,
  CAST(101 + p_size % 9 AS SMALLINT) AS fbfm40, CAST(p_size AS SMALLINT) AS cc,
  CAST(p_size * 10 AS SMALLINT) AS ch, CAST(round_even(p_size / 8.0::DOUBLE * 10, 0) AS SMALLINT) AS cbh,
  CAST(round_even(p_size / 400.0::DOUBLE * 100, 0) AS SMALLINT) AS cbd, 9999::SMALLINT AS evt,
  (i % 3 + 0.5::DOUBLE) * 30 AS x, 90 - (i // 3 + 0.5::DOUBLE) * 30 AS y
FROM {part}, range(9) r(i)""",
)
def synthetic_landscapes(t):
    size = F.col("p_size").cast("double")
    params = t.part.select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"),
        (F.lit(101) + F.col("p_size") % 9).alias("fbfm40"), size.alias("cc_pct"),
        (size / 400).alias("cbd_kg_m3"), (size / 8).alias("cbh_m"), size.alias("ch_m"),
        F.col("p_retailprice").alias("elev_m"), size.alias("slope_pct"), F.lit(-1).alias("aspect_deg"),
    )
    return synthetic.synthetic_landscapes(params, n_pixels=3)


@query(
    "P13",
    """SELECT t.row, t.col, s.flamelength
FROM {px} t LEFT JOIN (SELECT row AS sr, col AS sc, flamelength FROM {px}) s
  ON s.sr = CAST(floor((t.row + 0.5::DOUBLE) * 20 / 30) AS INT) AND s.sc = CAST(floor((t.col + 0.5::DOUBLE) * 20 / 30) AS INT)""",
)
def aligned_to_grid(t):
    source, target = Grid(cell=30.0), Grid(cell=20.0)
    return algebra.align_to_grid(
        t.px, source, t.px.select("row", "col"), target, ["flamelength"]
    )


@query(
    "P14",
    """SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, arg_min(value, tile) AS value FROM (
  SELECT row, col, 0 AS tile, flamelength AS value FROM {px}
  UNION ALL SELECT row + 3, col + 2, 1, bp FROM {px}) WHERE value IS NOT NULL GROUP BY row, col""",
)
def mosaic(t):
    band = F.lit("FL").alias("band")
    first = t.px.select(band, "row", "col", F.lit(0).alias("tile_ord"), F.col("flamelength").alias("value"))
    second = t.px.select(
        band, (F.col("row") + 3).alias("row"), (F.col("col") + 2).alias("col"),
        F.lit(1).alias("tile_ord"), F.col("bp").alias("value"),
    )
    return algebra.mosaic_first(first.unionByName(second)).drop("band")


@query(
    "P16 J11",
    """SELECT row, col, round(bp - bp_tr, 6) AS delta_bp,
  CAST(round_even((bp - bp_tr) * 100, 0) AS SMALLINT) AS delta_scaled FROM {px}""",
)
def delta_burn_probability(t):
    bl = t.px.select("row", "col", "bp")
    tr = t.px.select("row", "col", F.col("bp_tr").alias("bp"))
    return r6(algebra.delta_burn_probability(bl, tr))


@query("P17", "SELECT row, col, CAST(sdi - sdi_tr AS SMALLINT) AS delta_sdi FROM {px}")
def delta_sdi(t):
    return algebra.delta_sdi(
        t.px.select("row", "col", "sdi"), t.px.select("row", "col", F.col("sdi_tr").alias("sdi"))
    )


@query(
    "P18",
    """SELECT pix, CASE WHEN sdi <> 0 THEN round(abs(sdi - sdi_tr) / CAST(sdi AS DOUBLE) * 100, 6) END AS pct FROM {px}""",
)
def percent_change(t):
    d = F.col("sdi") - F.col("sdi_tr")
    return r6(t.px.select("pix", algebra.percent_change(d, "sdi").alias("pct")))


@query(
    "P19",
    """SELECT a.row, a.col, round(avg(b.flamelength), 6) AS flamelength_focal
FROM {px} a JOIN {px} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
GROUP BY a.row, a.col""",
)
def focal_mean(t):
    px = t.px.select("row", "col", "flamelength")
    out = focal.focal_mean(px, ["flamelength"], 56.41896, CELL)
    return r6(out.drop("flamelength"))


def _near(dr: int, dc: int) -> str:
    return f"coalesce(max(CASE WHEN b.row = a.row + {dr} AND b.col = a.col + {dc} THEN b.elev END), any_value(a.elev))"


@query(
    "P20",
    f"""SELECT row, col, round(sqrt(dx * dx + dy * dy) * 100, 6) AS slope_pct FROM (
 SELECT a.row, a.col,
  (({_near(-1, 1)} + 2 * {_near(0, 1)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(0, -1)} + {_near(1, -1)})) / 240.0::DOUBLE AS dx,
  (({_near(1, -1)} + 2 * {_near(1, 0)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(-1, 0)} + {_near(-1, 1)})) / 240.0::DOUBLE AS dy
 FROM {{px}} a JOIN {{px}} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
 GROUP BY a.row, a.col)""",
)
def slope_from_elevation(t):
    return r6(focal.slope_percent(t.px.select("row", "col", "elev"), CELL).drop("elev"))


# Pixels clipped to the treatment polygons: the cells between them are absent, not NULL.
CLIPPED = """SELECT p.row, p.col, p.flamelength, p.elev FROM {px} p
WHERE EXISTS (SELECT 1 FROM {zone_cells} z WHERE z.row = p.row AND z.col = p.col)"""


def clipped(t):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    return rasterize.clip_pixels(t.px.select("row", "col", "flamelength", "elev"), spans)


@query(
    "P19",
    """SELECT a.row, a.col, round(avg(b.flamelength), 6) AS flamelength_focal
FROM {clipped} a JOIN {clipped} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
GROUP BY a.row, a.col""",
    clipped=CLIPPED,
)
def focal_mean_clipped(t):
    out = focal.focal_mean(clipped(t).drop("elev"), ["flamelength"], 56.41896, CELL)
    return r6(out.drop("flamelength"))


@query(
    "P20",
    f"""SELECT row, col, round(sqrt(dx * dx + dy * dy) * 100, 6) AS slope_pct FROM (
 SELECT a.row, a.col,
  (({_near(-1, 1)} + 2 * {_near(0, 1)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(0, -1)} + {_near(1, -1)})) / 240.0::DOUBLE AS dx,
  (({_near(1, -1)} + 2 * {_near(1, 0)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(-1, 0)} + {_near(-1, 1)})) / 240.0::DOUBLE AS dy
 FROM {{clipped}} a JOIN {{clipped}} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
 GROUP BY a.row, a.col)""",
    clipped=CLIPPED,
)
def slope_from_clipped(t):
    return r6(focal.slope_percent(clipped(t).select("row", "col", "elev"), CELL).drop("elev"))


@query(
    "P21",
    """SELECT row, col, coalesce(undisturbed = 1 AND burnable = 1 AND bps = 1, false) AS keep FROM {masks}""",
)
def combined_mask(t):
    return t.masks.select(
        "row", "col", algebra.mask_conjunction("undisturbed", "burnable", "bps", None).alias("keep")
    )


@query(
    "P22",
    """SELECT row, col, count(*) FILTER (WHERE feas >= 1) AS n_feasible,
  CAST(count(*) FILTER (WHERE feas >= 1) >= 3 AS INT) AS feasible FROM {feas} GROUP BY row, col""",
)
def composite_feasibility(t):
    return algebra.composite_feasibility(t.feas)
