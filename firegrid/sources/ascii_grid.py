"""ArcInfo ASCII grids as pixel tables, and back.

Files are read as lines in splits, so a large grid is parsed by many tasks. The number of a line
follows from its position inside its split and the line counts of the earlier splits.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import Grid
from ..session import broadcast_if_small, checkpoint
from .catalog import list_files

# Grids a probability run writes, their file suffixes and band names.
PROBABILITY_GRIDS = {
    "_BurnProb.asc": "BurnProb",
    "_AvgFlameLength.asc": "AvgFlameLength",
    "_AvgTime.asc": "AvgTime",
}
HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def numbered_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``(path, line_no, value)`` with 0-based line numbers per file.

    Files are scanned once and the lines stored: two scans may be cut into different splits, and
    lines of splits that do not match would be lost in the join.
    """
    lines = checkpoint(
        spark.read.text(paths).select(
            F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_id"),
            "value",
        )
    )
    order = Window.partitionBy("path").orderBy("_at")
    splits = (
        lines.groupBy("path", "_at")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(order) - F.col("_n"))
        .select("path", "_at", "_first", "_base")
    )
    return lines.join(broadcast_if_small(splits), ["path", "_at"]).select(
        "path", (F.col("_base") + F.col("_id") - F.col("_first")).alias("line_no"), "value"
    )


def parse_ascii_grids(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels, headers) from numbered lines. Header lines have one of the six keys, in either
    case, and stand before the first row of data; nodata and NaN → NULL."""
    head = F.lower(F.regexp_extract("value", r"^\s*([A-Za-z_]+)\s+(\S+)", 1))
    number = F.regexp_extract("value", r"^\s*([A-Za-z_]+)\s+(\S+)", 2)
    marked = lines.withColumns({"_key": head, "_num": number})
    data = ~F.col("_key").isin(*HEADER) & (F.trim("value") != "")
    first = F.min(F.when(data, F.col("line_no")))
    headers = marked.groupBy("path").agg(
        *[
            F.max(F.when(F.col("_key") == k, F.col("_num").try_cast("double"))).alias(k)
            for k in HEADER
        ],
        first.alias("_skip"),
    )
    cells = (
        marked.join(broadcast_if_small(headers.select("path", "_skip", "nodata_value")), "path")
        .where(F.col("line_no") >= F.col("_skip"))
        .select(
            "path", (F.col("line_no") - F.col("_skip")).cast("int").alias("row"), "nodata_value",
            F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "_text"),
        )
        .where(F.col("_text") != "")
        .withColumn("_v", F.col("_text").try_cast("double"))
    )
    nodata = F.coalesce("nodata_value", F.lit(-9999.0))
    pixels = cells.select(
        "path", "row", "col",
        F.when((F.col("_v") != nodata) & ~F.isnan("_v"), F.col("_v")).alias("value"),
    )
    return pixels, headers.select("path", *HEADER)


def read_ascii_grids(spark: SparkSession, paths: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    return parse_ascii_grids(numbered_lines(spark, paths))


def read_probability_outputs(
    spark: SparkSession, folder: str, basename: str = "fspro_out"
) -> DataFrame:
    """Output grids of a probability run, stacked as ``(row, col, BurnProb, …)``. A missing grid
    is a warning and leaves its band out."""
    wanted = {f"{basename}{suffix}": band for suffix, band in PROBABILITY_GRIDS.items()}
    name = F.element_at(F.split("path", "/"), -1)
    found = {
        r["name"]: r["path"]
        for r in list_files(spark, folder, ".asc", recursive=False)
        .withColumn("name", name)
        .where(F.col("name").isin(list(wanted)))
        .collect()  # at most three names
    }
    for missing in sorted(set(wanted) - set(found)):
        warnings.warn(f"grid not found: {missing}", stacklevel=2)
    if not found:
        raise FileNotFoundError(f"no output grids of {basename} in {folder}")
    pixels, _ = read_ascii_grids(spark, list(found.values()))
    band = F.lit(None).cast("string")
    for file, b in wanted.items():
        band = F.when(F.endswith("path", F.lit(f"/{file}")), F.lit(b)).otherwise(band)
    bands = [b for f, b in wanted.items() if f in found]
    return (
        pixels.withColumn("band", band).groupBy("row", "col").pivot("band", bands).agg(F.first("value"))
    )


def header_grid(header, crs: str = "EPSG:5070") -> Grid:
    """Grid of a header row. The header names the lower left corner; row 0 is the top."""
    return Grid(
        x0=header["xllcorner"], y0=header["yllcorner"] + header["nrows"] * header["cellsize"],
        cell=header["cellsize"], nrows=int(header["nrows"]), ncols=int(header["ncols"]), crs=crs,
    )


def burned_grid_lines(spans: DataFrame, grid: Grid) -> DataFrame:
    """``(line_no, line)`` of an ASCII grid holding 1 on the cells of ``spans`` (merged, one
    feature) and 0 elsewhere. Rows are written as runs, not cell by cell."""
    spark = spans.sparkSession
    runs = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("c0", "c1"))).alias("_r"))

    def extend(acc: Column, run: Column) -> Column:
        text = F.concat(
            acc["text"], F.repeat(F.lit("0 "), run["c0"] - acc["at"]),
            F.repeat(F.lit("1 "), run["c1"] - run["c0"] + 1),
        )
        return F.struct(text.alias("text"), (run["c1"] + 1).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    none = F.array().cast("array<struct<c0:int,c1:int>>")
    body = F.aggregate(F.coalesce("_r", none), start, extend)
    line = F.rtrim(F.concat(body["text"], F.repeat(F.lit("0 "), F.lit(grid.ncols) - body["at"])))
    rows = (
        spark.range(grid.nrows)
        .select(F.col("id").cast("int").alias("row"))
        .join(runs, "row", "left")
        .select((F.col("row") + 6).alias("line_no"), line.alias("line"))
    )
    header = [
        f"ncols {grid.ncols}", f"nrows {grid.nrows}", f"xllcorner {grid.x0}",
        f"yllcorner {grid.y0 - grid.nrows * grid.cell}", f"cellsize {grid.cell}", "NODATA_value 0",
    ]
    head = spark.createDataFrame(list(enumerate(header)), "line_no int, line string")
    return head.unionByName(rows)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write lines in order; the part files in name order are the document."""
    lines.orderBy("line_no").select("line").write.mode("overwrite").text(path)
