"""Shared schemas, grid georeference and the column check every public operator starts with."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumnsError(KeyError, ValueError):
    """Raised on the driver, before any job starts, when an input lacks required columns."""

    def __str__(self) -> str:
        return str(self.args[0])


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"{what} lacks required columns {missing}; it has {df.columns}")


@dataclass(frozen=True)
class Grid:
    """Georeference of a raster: row 0 is the top row, cells are square.

    ``nrows`` and ``ncols`` may be left out when the extent does not matter (no clipping).
    """

    x0: float = 0.0
    y0: float = 0.0
    cell: float = 30.0
    nrows: int | None = None
    ncols: int | None = None
    crs: str = "EPSG:5070"

    def gx(self, x: Column | str) -> Column:
        """Horizontal grid coordinate: 0 at the left edge, one unit per cell."""
        x = F.col(x) if isinstance(x, str) else x
        return (x - F.lit(float(self.x0))) / F.lit(float(self.cell))

    def gy(self, y: Column | str) -> Column:
        """Vertical grid coordinate: 0 at the top edge, growing downward."""
        y = F.col(y) if isinstance(y, str) else y
        return (F.lit(float(self.y0)) - y) / F.lit(float(self.cell))

    def x(self, col: Column | str) -> Column:
        col = F.col(col) if isinstance(col, str) else col
        return F.lit(float(self.x0)) + (col + 0.5) * F.lit(float(self.cell))

    def y(self, row: Column | str) -> Column:
        row = F.col(row) if isinstance(row, str) else row
        return F.lit(float(self.y0)) - (row + 0.5) * F.lit(float(self.cell))

    def inside(self, row: str = "row", col: str = "col") -> Column:
        ok = (F.col(row) >= 0) & (F.col(col) >= 0)
        if self.nrows is not None:
            ok = ok & (F.col(row) < self.nrows)
        if self.ncols is not None:
            ok = ok & (F.col(col) < self.ncols)
        return ok


def grid_from_row(row) -> Grid:
    """Build a :class:`Grid` from one row of a ``grids`` table."""
    d = row.asDict() if hasattr(row, "asDict") else dict(row)
    return Grid(**{k: d[k] for k in ("x0", "y0", "cell", "nrows", "ncols", "crs") if k in d})


EDGE_COLUMNS = ("feature_id", "x1", "y1", "x2", "y2")

GRIDS = T.StructType(
    [
        T.StructField("grid_id", T.StringType(), False),
        T.StructField("crs", T.StringType(), False),
        T.StructField("x0", T.DoubleType(), False),
        T.StructField("y0", T.DoubleType(), False),
        T.StructField("cell", T.DoubleType(), False),
        T.StructField("nrows", T.IntegerType(), False),
        T.StructField("ncols", T.IntegerType(), False),
    ]
)

PIXELS = T.StructType(
    [
        T.StructField("raster_id", T.StringType(), False),
        T.StructField("band", T.StringType(), False),
        T.StructField("row", T.IntegerType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("value", T.DoubleType(), True),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("feature_id", T.LongType(), False),
        T.StructField("part", T.IntegerType(), False),
        T.StructField("ring", T.IntegerType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("x1", T.DoubleType(), False),
        T.StructField("y1", T.DoubleType(), False),
        T.StructField("x2", T.DoubleType(), False),
        T.StructField("y2", T.DoubleType(), False),
    ]
)
