"""Projections and regridding between them."""

import math

import pytest
from pyspark.sql import functions as F

from firegrid import Grid
from firegrid.functions import albers, utm
from firegrid.operators import algebra


def test_round_trips_under_a_millimetre(spark):
    places = [(-125.0 + 3 * i, 24.0 + 1.3 * j) for i in range(20) for j in range(20)]
    df = spark.createDataFrame(places, "lon double, lat double").withColumn("_", F.rand(1))
    x, y = albers.to_epsg5070("lon", "lat")
    df = df.withColumns({"x": x, "y": y})
    lon, lat = albers.from_epsg5070("x", "y")
    near = df.where(F.abs(F.col("lon") + 111) < 4)
    e, n = utm.to_utm("lon", "lat", 12)
    near = near.withColumns({"e": e, "n": n})
    lon2, lat2 = utm.from_utm("e", "n", 12)
    worst = lambda d, a, b: d.agg(F.max(F.greatest(F.abs(a - F.col("lon")), F.abs(b - F.col("lat"))))).first()[0]
    assert worst(df, lon, lat) * 111_000 < 1e-3 and worst(near, lon2, lat2) * 111_000 < 1e-3


def test_known_positions(spark):
    """On the central meridian and the equator, and by the length of the meridian."""
    one = spark.createDataFrame([(-111.0, 0.0), (-111.0, 45.0)], "lon double, lat double")
    e, n = utm.to_utm("lon", "lat", 12)
    got = [tuple(r) for r in one.select(e, n).collect()]
    assert got[0] == pytest.approx((500_000, 0), abs=1e-6)
    # Simpson's rule along the meridian of the ellipsoid.
    e2, steps = albers._E2, 2000
    arc = lambda p: albers.SEMI_MAJOR * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    h = math.pi / 4 / steps
    length = h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * arc(i * h) for i in range(steps + 1))
    assert got[1] == pytest.approx((500_000, 0.9996 * length), abs=1e-3)


def test_unknown_systems(spark):
    for a, b in (("EPSG:5070", "EPSG:3857"), ("EPSG:26999", "EPSG:5070")):
        with pytest.raises(ValueError, match="no transformation"):
            utm.transformed("x", "y", a, b)
    assert utm.zone_of("EPSG:32610") == 10 and utm.zone_of("EPSG:32700") is None


def test_bilinear_leaves_missing_cells_out(spark):
    grid = Grid(x0=0.0, y0=0.0, cell=10.0)
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "row int, col int, v double")
    fine = Grid(x0=5.0, y0=-5.0, cell=5.0)
    target = spark.createDataFrame([(0, 0), (0, 1), (9, 9)], "row int, col int")
    got = {(r[0], r[1]): r[2] for r in algebra.regrid(cells, grid, target, fine, ["v"], bilinear=True).collect()}
    a, b = (1 * 9 + 3 * 3 + 5 * 1) / 13, (1 * 3 + 3 * 9 + 5 * 3) / 15
    assert got == {(0, 0): pytest.approx(a), (0, 1): pytest.approx(b), (9, 9): None}
    nearest = {(r[0], r[1]): r[2] for r in algebra.regrid(cells, grid, target, fine, ["v"]).collect()}
    assert nearest == {(0, 0): 1.0, (0, 1): 3.0, (9, 9): None}
