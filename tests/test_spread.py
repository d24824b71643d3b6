"""Operators that turn a row into many deal their input to tasks first; results are compared in other tests."""

import pytest
from pyspark.sql import functions as F
from test_tables import bundle

from firegrid import Grid
from firegrid.operators import algebra, distance, spatial_join
from firegrid.plans import container
from firegrid.session import spread
from firegrid.sources import documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, n):
    """Lines in one partition, as a small file gives them."""
    at = ("CAST((id * 41) % 80 AS DOUBLE) * 30 AS x1", "-CAST(id AS DOUBLE) * 45 AS y1")
    to = ("CAST((id * 41) % 80 + 4 AS DOUBLE) * 30 AS x2", "-CAST(id + 2 AS DOUBLE) * 45 AS y2")
    return spark.range(n).coalesce(1).selectExpr("id AS feature_id", "0 AS seq", *at, *to)


def test_spread_follows_the_rows_that_are_made(spark):
    df = spark.range(1000).coalesce(1)
    assert spread(df, 100, per_task=10_000).rdd.getNumPartitions() == 10
    assert spread(df, df["id"] % 2, "id", per_task=100).rdd.getNumPartitions() == 5
    assert spread(df.limit(0), 1).rdd.getNumPartitions() == 1


def test_cells_of_lines_are_grouped_where_they_are_made(spark):
    grid = Grid(x0=0.0, y0=0.0, cell=30.0, nrows=5000, ncols=100)
    for df in (distance.line_cell_distance(lines(spark, 300), grid, 450.0), distance.line_length_in_circle(lines(spark, 300), grid)):
        assert "REPARTITION_BY_NUM" in plan(df) and "ENSURE_REQUIREMENTS" not in plan(df)
    many = distance.line_cell_distance(lines(spark, 3000), grid, 450.0)
    assert many.rdd.getNumPartitions() > 1  # over 500,000 cells


def test_bands_cut_no_cell_off(spark):
    """A line over several bands of rows, and along the border between two."""
    grid, band = Grid(x0=0.0, y0=0.0, cell=1.0, nrows=300, ncols=50), float(distance.BAND)
    rows = [(1, 20.5, -3.5, 20.5, -290.5), (2, 3.5, -band, 30.5, -band)]
    edges = spark.createDataFrame(rows, "feature_id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["feature_id"], r["row"], r["col"]): r["distance_m"] for r in distance.line_cell_distance(edges, grid, 3.0).collect()}
    want = {}
    for f, x1, y1, x2, y2 in rows:
        for r in range(300):
            for c in range(50):
                x, y = c + 0.5, -(r + 0.5)
                d = ((x - min(max(x, x1), x2)) ** 2 + (y - min(max(y, y2), y1)) ** 2) ** 0.5
                if d <= 3.0:
                    want[f, r, c] = d
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_points_and_edges_of_small_files_are_dealt(spark):
    """Before, pairs were made by the single task that read the points or the polygons."""
    zones = lines(spark, 300).selectExpr("feature_id", "0 AS part", "0 AS ring", "seq", "x1", "y1", "x2", "y2")
    points = spark.range(50_000).coalesce(1).selectExpr("id AS point_id", "id % 3000 + 0.5D AS x", "-(id % 13000) - 0.5D AS y")
    for df in (spatial_join.points_within_distance(points, zones, 60.0), spatial_join.near_line_flag(zones, lines(spark, 300), 120.0)):
        assert "REPARTITION_BY_NUM" in plan(df)


def test_lines_exactly_at_the_distance_are_near(spark):
    """Boxes are compared before distances; neither the limit nor a diagonal neighbour may be lost."""
    box = [(0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 10.0, 10.0), (10.0, 10.0, 0.0, 10.0), (0.0, 10.0, 0.0, 0.0)]
    rows = [(f, 0, 0, i, a + 1e4 * f, b, c + 1e4 * f, d) for f in range(5) for i, (a, b, c, d) in enumerate(box)]
    zones = spark.createDataFrame(rows, "feature_id int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    away = [(0, 12.5, -50.0, 12.5, 50.0), (1, 12.6, -50.0, 12.6, 50.0), (2, 11.5, 12.0, 40.0, 40.0), (3, 11.6, 12.0, 40.0, 40.0), (4, -20.0, 5.0, 30.0, 5.0)]
    segs = spark.createDataFrame([(f, x1 + 1e4 * f, y1, x2 + 1e4 * f, y2) for f, x1, y1, x2, y2 in away], "feature_id int, x1 double, y1 double, x2 double, y2 double")
    got = {r["feature_id"]: r["pod_line"] for r in spatial_join.near_line_flag(zones, segs, 2.5).collect()}
    assert got == {0: "Line", 1: "Interior", 2: "Line", 3: "Interior", 4: "Line"}


def test_pixels_of_a_band_stay_where_they_are(spark):
    """All pixels of a raster's band have one key; a join by it moved and sorted them in a few tasks."""
    px = spark.range(1000).selectExpr(
        "'r' AS raster_id", "CAST(id % 3 AS INT) AS band_index", "concat('LC_', id % 3) AS band", "CAST(id AS INT) AS row", "0 AS col", "0D AS value"
    )
    found = algebra.find_band(px.select("raster_id", "band_index", "band").distinct(), px, "lc_1")
    assert found.count() == 333 and "Exchange hashpartitioning" not in plan(found)


def test_documents_are_written_once_a_region(spark):
    """Before, every container's document was formatted anew, all of them by one task."""
    spans = spark.createDataFrame([(1, 0, 0, 3), (2, 1, 2, 5)], "container_id int, row int, c0 int, c1 int")
    regions = spark.createDataFrame([("9", 0, 0, 9), ("9", 1, 0, 9)], "pyrome string, row int, c0 int, c1 int")
    lines, _ = container.prepare_containers(spans, regions, bundle(spark), "/out", 2022, NumFires=5)
    assert "REPARTITION_BY_NUM" in plan(lines)
    for i in (1, 2):
        want = documents.fspro_lines(bundle(spark), f"/out/{i}/ignitions/container_ignition.shp", NumFires=5)
        got = lines.where(f"container_id = {i}").select("line_no", "line")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("line_no", "line").collect()))
    lost = regions.withColumn("pyrome", F.lit("8"))
    with pytest.raises(Exception, match="no weather for region 8"):
        container.prepare_containers(spans, lost, bundle(spark), "/out", 2022)[0].collect()
