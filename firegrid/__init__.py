"""firegrid: wildfire-planning analytics on Spark tables.

Rasters are pixel tables, polygons and lines are edge tables, weather records are
observation tables.  Every operator takes and returns DataFrames.
"""

from .schema import Grid, MissingColumnsError, require_columns
from .session import build_session, tune

__all__ = ["Grid", "MissingColumnsError", "require_columns", "build_session", "tune"]
