"""Per-pixel landscape algebra: band selection, edits, differences, masks, mosaics.

Wide pixel tables hold one row per cell with a column per band; long tables hold
``(raster_id, band, row, col, value)``. Missing pixels are NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import half_even, missing_to_null
from ..functions.utm import transformed
from ..schema import Grid, require_columns
from ..session import broadcast_if_small

CELL = ["row", "col"]


def select_band(
    pixels: DataFrame,
    name: str,
    bands: DataFrame | None = None,
    keys: Sequence[str] = ("raster_id",),
) -> DataFrame:
    """Pixels of the band with exactly this name; a raster lacking it raises an error.

    ``bands`` is the catalog ``(raster_id, band)``; without one the band names are aggregated
    from the pixel table (one column, partial aggregation).
    """
    require_columns(pixels, ["band", *keys], "pixels")
    known = (bands if bands is not None else pixels).groupBy(*keys).agg(
        F.bool_or(F.col("band") == name).alias("has")
    )
    if not known.where(~F.col("has")).isEmpty():
        raise ValueError(f"{name!r} not found among the bands of every raster")
    return pixels.where(F.col("band") == name)


def find_band(bands: DataFrame, pixels: DataFrame, name: str) -> DataFrame:
    """First band (by ``band_index``) whose name contains ``name``, ignoring case.

    Rasters with a single band are returned as they are. ``bands`` is the catalog
    ``(raster_id, band_index, band)``; the chosen bands are broadcast if few, so that the pixels stay where they are.
    """
    order = Window.partitionBy("raster_id").orderBy(
        (~F.lower("band").contains(name.lower())).cast("int"), "band_index"
    )
    size = Window.partitionBy("raster_id")
    chosen = (
        bands.withColumn("_n", F.count("*").over(size))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1)
        .withColumn(
            "band",
            F.when(
                (F.col("_n") > 1) & ~F.lower("band").contains(name.lower()),
                F.raise_error(F.concat(F.lit(f"band {name} not found in "), "raster_id")),
            ).otherwise(F.col("band")),
        )
        .select("raster_id", "band")
    )
    return pixels.join(broadcast_if_small(chosen), ["raster_id", "band"], "left_semi")


def stack_bands(
    files: DataFrame, band_names: Sequence[str], keys: Sequence[str] = ("raster_id",)
) -> DataFrame:
    """Wide stack of single-band rasters; the band name is the text after the last ``_``.

    The list of bands is fixed by the caller, so the pivot needs no extra pass.
    """
    require_columns(files, ["file", "row", "col", "value", *keys], "files")
    return (
        files.withColumn("_band", F.element_at(F.split("file", "_"), -1))
        .groupBy(*keys, *CELL)
        .pivot("_band", list(band_names))
        .agg(F.first("value"))
    )


def nodata_to_null(pixels: DataFrame, columns: Sequence[str], nodata: float) -> DataFrame:
    return pixels.withColumns({c: missing_to_null(c, nodata) for c in columns})


def adjust_by_evt(
    pixels: DataFrame,
    evt_code: int = 7050,
    cbh_adjust: float | None = 0.70,
    fbfm_to: int | None = 185,
) -> DataFrame:
    """Scale CBH and set the fuel model where the vegetation type matches; other pixels keep."""
    require_columns(pixels, ["evt"], "pixels")
    hit = F.coalesce(F.col("evt") == evt_code, F.lit(False))
    new = {}
    if cbh_adjust is not None and "cbh" in pixels.columns:
        new["cbh"] = F.when(hit, F.col("cbh") * cbh_adjust).otherwise(F.col("cbh").cast("double"))
    if fbfm_to is not None and "fbfm40" in pixels.columns:
        kind = pixels.schema["fbfm40"].dataType
        new["fbfm40"] = F.when(hit, F.lit(fbfm_to).cast(kind)).otherwise(F.col("fbfm40"))
    return pixels.withColumns(new) if new else pixels


def apply_edit_rules(pixels: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Ordered edit rules. A rule is ``{"conditions": [(product, "EQ", value), …],
    "changes": [(product, "ST"|"MB", value), …]}``; all its conditions must hold. Later rules see
    the result of earlier ones; the changes of one rule see the same pixel state.
    """
    for rule in rules:
        names = {c[0] for c in rule["conditions"]} | {c[0] for c in rule["changes"]}
        require_columns(pixels, names, "pixels")
        for _, op, _ in rule["conditions"]:
            if op != "EQ":
                raise ValueError(f"unknown condition {op!r}")
        hit = reduce(
            lambda a, b: a & b, [F.col(p) == v for p, _, v in rule["conditions"]], F.lit(True)
        )
        changed = {}
        for product, op, value in rule["changes"]:
            if op not in ("ST", "MB"):
                raise ValueError(f"unknown change {op!r}")
            old = F.col(product).cast("double")
            new = F.lit(float(value)) if op == "ST" else old * float(value)
            changed[product] = F.when(hit, new).otherwise(old)
        pixels = pixels.withColumns(changed)
    return pixels


def align_to_grid(source: DataFrame, source_grid: Grid, target: DataFrame, target_grid: Grid,
                  columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-neighbour regrid: each target cell takes the source cell under its centre."""
    if source_grid.crs != target_grid.crs:
        raise ValueError(f"grids differ in CRS: {source_grid.crs} and {target_grid.crs}")
    lookup = source.select(
        *keys, F.col("row").alias("_srow"), F.col("col").alias("_scol"), *columns
    )
    placed = target.withColumns(
        {
            "_srow": F.floor(source_grid.gy(target_grid.y("row"))).cast("int"),
            "_scol": F.floor(source_grid.gx(target_grid.x("col"))).cast("int"),
        }
    )
    return placed.join(lookup, [*keys, "_srow", "_scol"], "left").drop("_srow", "_scol")


def regrid(source: DataFrame, source_grid: Grid, target: DataFrame, target_grid: Grid, columns: Sequence[str], bilinear: bool = False) -> DataFrame:
    """``target`` cells with the ``columns`` of a source grid in any known system.

    Each target centre is mapped back into the source grid and takes the cell it lies in, or, ``bilinear``, the mean of the
    four nearest centres weighted by nearness; missing cells leave the mean to the others. The source is shuffled
    once by (row, col), as are the targets, or their four neighbours.
    """
    x, y = transformed(target_grid.x("col"), target_grid.y("row"), target_grid.crs, source_grid.crs)
    cells = source.select(F.col("row").alias("_srow"), F.col("col").alias("_scol"), *[F.col(c).alias(f"_v_{c}") for c in columns])
    placed = target.select("row", "col", x.alias("_x"), y.alias("_y"))
    placed = placed.select("row", "col", source_grid.gx(F.col("_x")).alias("_gx"), source_grid.gy(F.col("_y")).alias("_gy"))
    if not bilinear:
        index = {"_srow": F.floor("_gy").cast("int"), "_scol": F.floor("_gx").cast("int")}
        joined = placed.withColumns(index).join(cells, ["_srow", "_scol"], "left")
        return joined.select("row", "col", *[F.col(f"_v_{c}").alias(c) for c in columns])
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    low = {"_r": F.floor(F.col("_gy") - 0.5), "_c": F.floor(F.col("_gx") - 0.5)}
    near = placed.withColumns(low).withColumn("_k", corner)
    share = lambda g, at, i: 1.0 - F.abs(F.col(g) - 0.5 - F.col(at) - F.col(i))
    near = near.select(
        "row", "col", (F.col("_r") + F.col("_k.i")).cast("int").alias("_srow"), (F.col("_c") + F.col("_k.j")).cast("int").alias("_scol"),
        (share("_gy", "_r", "_k.i") * share("_gx", "_c", "_k.j")).alias("_w"),
    )
    met = near.join(cells, ["_srow", "_scol"], "left").groupBy("row", "col")
    mean = lambda c: F.try_divide(F.sum(F.col("_w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))))
    return met.agg(*[mean(f"_v_{c}").alias(c) for c in columns])


def mosaic_first(tiles: DataFrame, keys: Sequence[str] = ("band",), order: str = "tile_ord"):
    """First valid pixel in tile order. ``row``/``col`` are global. Band names follow the band
    index of the first tile when tiles name them differently (``band_index`` as key)."""
    return (
        tiles.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*keys, *CELL)
        .agg(F.min_by("value", order).alias("value"))
    )


def mosaic_band_names(tiles: DataFrame, order: str = "tile_ord") -> DataFrame:
    """Band names of the first tile, by band index."""
    return tiles.groupBy("band_index").agg(F.min_by("band", order).alias("band"))


def delta_burn_probability(
    baseline: DataFrame, treated: DataFrame, keys: Sequence[str] = (), scale: int | None = 100
) -> DataFrame:
    """Baseline minus treated burn probability, aligned left on the baseline's cells.

    ``delta_scaled`` is the difference times ``scale``, rounded half to even, as SMALLINT.
    """
    on = [*keys, *CELL]
    out = baseline.select(*on, F.col("bp").alias("_bl")).join(
        treated.select(*on, F.col("bp").alias("_tr")), on, "left"
    )
    delta = F.col("_bl") - F.col("_tr")
    cols = [*on, delta.alias("delta_bp")]
    if scale is not None:
        cols.append(half_even(delta * scale).cast("smallint").alias("delta_scaled"))
    return out.select(*cols)


def delta_sdi(
    baseline: DataFrame,
    treated: DataFrame,
    keys: Sequence[str] = (),
    baseline_grid: Grid | None = None,
    treated_grid: Grid | None = None,
) -> DataFrame:
    """Baseline minus treated SDI (positive = easier); the treated side is regridded if needed."""
    on = [*keys, *CELL]
    base = baseline.select(*on, F.col("sdi").alias("_bl"))
    other = treated.select(*on, F.col("sdi").alias("_tr"))
    if baseline_grid is not None and treated_grid is not None and baseline_grid != treated_grid:
        joined = align_to_grid(other, treated_grid, base, baseline_grid, ["_tr"], keys)
    else:
        joined = base.join(other, on, "left")
    delta = F.col("_bl").cast("int") - F.col("_tr").cast("int")
    return joined.select(*on, delta.cast("smallint").alias("delta_sdi"))


def percent_change(delta: Column | str, baseline: Column | str) -> Column:
    """abs(delta) / baseline x 100, NULL where the baseline is 0."""
    d = F.col(delta) if isinstance(delta, str) else delta
    b = F.col(baseline) if isinstance(baseline, str) else baseline
    return F.try_divide(F.abs(d).cast("double"), b.cast("double")) * 100.0


def mask_conjunction(*flags: Column | str | None) -> Column:
    """True where every given 0/1 mask is 1; absent masks are ignored, missing cells excluded."""
    given = [F.col(f) if isinstance(f, str) else f for f in flags if f is not None]
    return reduce(
        lambda a, b: a & b, [F.coalesce(f == 1, F.lit(False)) for f in given], F.lit(True)
    )


def composite_feasibility(
    feasibility: DataFrame, keys: Sequence[str] = (), min_scenarios: int = 3
) -> DataFrame:
    """Per pixel: number of scenarios with feasibility >= 1 and whether it reaches the threshold.

    ``feasibility`` is long: ``(row, col, scenario, feas)``.
    """
    n = F.count_if(F.col("feas") >= 1)
    return feasibility.groupBy(*keys, *CELL).agg(
        n.alias("n_feasible"), (n >= min_scenarios).cast("int").alias("feasible")
    )
