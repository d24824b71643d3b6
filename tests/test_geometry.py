"""Geometry on a 5x5 grid with cells of 1 m, by hand, and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from firegrid import Grid
from firegrid.operators import distance, focal, geometry, lines, overlap, rasterize, spatial_join

G5 = Grid(x0=0.0, y0=5.0, cell=1.0, nrows=5, ncols=5)
EDGE = "feature_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def polygon(fid, *rings):
    """Edge rows of rings given as (part, ring, [(x, y), …])."""
    return [
        (fid, part, ring, i, *map(float, a), *map(float, b))
        for part, ring, pts in rings
        for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1]))
    ]


def square(x, y, w, h=None):
    h = h or w
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def frame(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def cells(df, *cols):
    return sorted(tuple(r[c] for c in (*cols, "row", "col")) for r in df.collect())


def test_polygon_cells_with_hole_parts_and_edge_on_grid_line(spark):
    rows = polygon(1, (0, 0, square(1, 1, 3)), (0, 1, square(2, 2, 1)), (1, 0, square(4, 4, 1)))
    got = cells(rasterize.span_cells(rasterize.polygon_spans(frame(spark, rows), G5)))
    block = {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)} - {(2, 2)}
    assert got == sorted(block | {(0, 4)})


def test_tiny_and_off_grid_polygons_cover_nothing(spark):
    rows = polygon(1, (0, 0, square(0.1, 0.1, 0.2))) + polygon(2, (0, 0, square(50, 50, 3)))
    assert rasterize.polygon_spans(frame(spark, rows), G5).count() == 0
    touched = cells(rasterize.span_cells(rasterize.touched_spans(frame(spark, rows), G5)), "feature_id")
    assert touched == [(1, 4, 0)]


def test_last_feature_wins(spark):
    rows = polygon(1, (0, 0, square(0, 0, 3))) + polygon(2, (0, 0, square(2, 0, 3)))
    spans = rasterize.polygon_spans(frame(spark, rows), G5)
    attrs = spark.createDataFrame([(1, 9), (2, 3)], "feature_id long, ord int")
    zones = {(r, c): f for f, r, c in cells(rasterize.zone_pixels(spans, attrs), "feature_id")}
    assert zones[(4, 2)] == 1 and zones[(4, 3)] == 2
    again = cells(rasterize.span_cells(rasterize.disjoint_spans(spans, attrs)), "feature_id")
    assert again == sorted((f, r, c) for (r, c), f in zones.items())


def test_line_cells(spark):
    rows = [(1, 0, 0, 0, 0.5, 4.5, 3.5, 2.5), (2, 0, 0, 0, 1.0, 0.2, 1.0, 1.8), (3, 0, 0, 0, 0.5, 2.0, 2.5, 2.0)]
    got = cells(rasterize.span_cells(rasterize.line_spans(frame(spark, rows), G5)), "feature_id")
    assert [c for c in got if c[0] == 2] == [(2, 3, 1), (2, 4, 1)]
    assert [c for c in got if c[0] == 3] == [(3, 3, 0), (3, 3, 1), (3, 3, 2)]
    # (0.5, 0.5) → (3.5, 2.5) in grid units leaves row 0 at x = 1.25 and row 1 at x = 2.75
    assert [c for c in got if c[0] == 1] == [(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 2), (1, 2, 2), (1, 2, 3)]


def test_merged_spans_count_cells_once(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 2), (1, 0, 2, 4), (1, 0, 5, 6), (1, 0, 9, 9), (1, 1, 1, 1)],
        "feature_id long, row int, c0 int, c1 int",
    )
    got = sorted(map(tuple, rasterize.merge_spans(df).select("row", "c0", "c1").collect()))
    assert got == [(0, 0, 6), (0, 9, 9), (1, 1, 1)]


@pytest.mark.parametrize("bound", [10**9, -1])
def test_pixel_join_is_the_same_with_and_without_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(rasterize, "BROADCAST_ROWS", bound)
    px = spark.range(600).select((F.col("id") % 2).cast("int").alias("row"), F.floor(F.col("id") / 2).cast("int").alias("col"))
    spans = spark.createDataFrame([(7, 0, 250, 270), (8, 1, 0, 0)], "feature_id long, row int, c0 int, c1 int")
    got = rasterize.join_pixels(px, spans)
    assert got.count() == 22 and got.where("feature_id = 7").agg(F.min("col"), F.max("col")).first() == (250, 270)


def test_areas_centroids_keys(spark):
    hole = polygon(1, (0, 0, square(0, 0, 4)), (0, 1, square(0, 0, 2)))
    turned = [(2, p, r, s, x2, y2, x1, y1) for _, p, r, s, x1, y1, x2, y2 in hole]
    moved = [(3, *e[1:4], e[4] + 0.02, e[5], e[6] + 0.02, e[7]) for e in hole]
    df = frame(spark, hole + turned + moved)
    area = {r["feature_id"]: r["area_m2"] for r in geometry.polygon_areas(df).collect()}
    assert area[1] == area[2] == 12.0
    c = {r["feature_id"]: (r["cx"], r["cy"]) for r in geometry.centroids(df).collect()}
    assert c[1] == pytest.approx(((16 * 2 - 4 * 1) / 12, (16 * 2 - 4 * 1) / 12))
    keys = {r["feature_id"]: r["geom_key"] for r in geometry.geometry_keys(df).collect()}
    assert keys[1] == keys[2] != keys[3]
    point = frame(spark, [(4, 0, 0, 0, 1.0, 1.0, 1.001, 1.0)])
    assert geometry.geometry_keys(point).first()["geom_key"] is None


def test_invalid_rings_are_dropped(spark):
    open_ring = polygon(1, (0, 0, square(0, 0, 2)))[:3]
    line = polygon(2, (0, 0, [(0, 0), (1, 1)]))
    flat = polygon(3, (0, 0, [(0, 0), (1, 0), (2, 0)]))
    good = polygon(4, (0, 0, square(0, 0, 1)))
    df = geometry.valid_rings(frame(spark, open_ring + line + flat + good))
    assert {r["feature_id"] for r in df.collect()} == {4}


def test_distance_transform_matches_brute_force(spark):
    rnd = random.Random(3)
    marked = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(12)]
    df = spark.createDataFrame(marked, "row int, col int")
    got = {(r["row"], r["col"]): r["distance_m"] for r in distance.cell_distance(df, 30.0, 300.0).collect()}
    for r in range(-2, 44):
        for c in range(-2, 44):
            d = min(math.hypot(r - a, c - b) for a, b in marked) * 30
            assert got.get((r, c)) == (pytest.approx(d) if d <= 300 + 1e-6 else None)


def test_no_usable_road(spark):
    roads = frame(spark, [(1, 0, 0, 0, 0.0, 0.0, 1.0, 1.0)]).withColumn("highway_code", F.lit(9))
    with pytest.raises(RuntimeError, match="highway_code"):
        distance.road_distance(roads, G5)


def test_length_in_circle(spark):
    df = frame(spark, [(1, 0, 0, 0, -100.0, 2.5, 100.0, 2.5)])
    got = {(r["row"], r["col"]): r["trail_m"] for r in distance.line_length_in_circle(df, G5, 1.5).collect()}
    assert got[(2, 2)] == pytest.approx(3.0)
    assert got[(1, 2)] == pytest.approx(2 * math.sqrt(1.25))
    assert (0, 2) not in got


@pytest.mark.parametrize("tile", [3.0, 7.3, 100.0])
def test_point_in_polygon_matches_ray_casting(spark, tile):
    rnd = random.Random(11)
    star = [
        (20 + (8 if i % 2 else 18) * math.cos(i * math.pi / 9), 20 + (8 if i % 2 else 18) * math.sin(i * math.pi / 9))
        for i in range(18)
    ]
    rows = polygon(1, (0, 0, star), (0, 1, square(19, 19, 3))) + polygon(2, (0, 0, square(-5, -5, 30)))
    pts = [(i, rnd.uniform(-10, 45), rnd.uniform(-10, 45)) for i in range(400)]
    got = {
        (r["point_id"], r["feature_id"])
        for r in spatial_join.points_in_polygons(
            spark.createDataFrame(pts, "point_id long, x double, y double"), frame(spark, rows), tile
        ).collect()
    }

    def inside(fid, x, y):
        hit = False
        for f, _, _, _, x1, y1, x2, y2 in rows:
            if f == fid and (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
                hit = not hit
        return hit

    assert got == {(i, f) for i, x, y in pts for f in (1, 2) if inside(f, x, y)}


def test_points_within_distance_keeps_every_polygon(spark):
    rows = polygon(1, (0, 0, square(0, 0, 2))) + polygon(2, (0, 0, square(3, 0, 2)))
    pts = spark.createDataFrame([(1, 2.5, 1.0), (2, 1.0, 1.0), (3, 9.0, 9.0)], "point_id long, x double, y double")
    out = spatial_join.points_within_distance(pts, frame(spark, rows), 0.6)
    assert sorted((r["point_id"], r["feature_id"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_near_line_flag(spark):
    rows = polygon(1, (0, 0, square(0, 0, 10))) + polygon(2, (0, 0, square(30, 0, 2))) + polygon(3, (0, 0, square(50, 0, 2)))
    segs = frame(spark, [(9, 0, 0, 0, 4.0, 4.0, 5.0, 5.0), (9, 0, 0, 1, 34.0, 0.0, 34.0, 9.0)])
    got = {r["feature_id"]: r["pod_line"] for r in spatial_join.near_line_flag(frame(spark, rows), segs, 2.5).collect()}
    assert got == {1: "Line", 2: "Line", 3: "Interior"}


def test_nearest_points_widen_the_search(spark):
    rnd = random.Random(5)
    grid = [(i, rnd.uniform(0, 4) + (359 if i % 2 else 0) % 360, rnd.uniform(0, 4)) for i in range(60)]
    lattice = spark.createDataFrame(grid, "gid long, lon double, lat double")
    pts = [(1, 0.1, 0.1), (2, 2.0, 2.0), (3, -3.0, 6.0), (4, 2.0, 2.0), (5, 120.0, -70.0)]
    out = spatial_join.nearest_grid_points(
        spark.createDataFrame(pts, "point_id long, lon double, lat double"), lattice, k=3, bucket_deg=0.5
    ).collect()
    norm = lambda v: (v + 180) % 360 - 180
    for pid, lon, lat in pts:
        want = sorted((math.hypot(lon - norm(x), lat - y), g) for g, x, y in grid)[:3]
        got = sorted((r["distance_deg"], r["gid"]) for r in out if r["point_id"] == pid)
        assert [g for _, g in got] == [g for _, g in want]
    with pytest.raises(ValueError, match="only"):
        spatial_join.nearest_grid_points(
            spark.createDataFrame(pts, "point_id long, lon double, lat double"), lattice, k=99
        )


def test_wedge_points_downwind(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "feature_id long, cx double, cy double, wind_direction double")
    e = spatial_join.wedge_edges(c, buffer_km=1.0, sector_degrees=90.0)
    assert e.count() == 33
    # wind from the north blows south: the arc lies south of the centre
    ys = [r["y1"] for r in e.where("seq between 1 and 32").collect()]
    assert max(ys) == pytest.approx(-1000 * math.cos(math.radians(45)))
    assert geometry.polygon_areas(e).first()["area_m2"] == pytest.approx(math.pi * 1e6 / 4, rel=1e-3)


def test_focal_mean_and_slope_across_tiles(spark):
    px = spark.range(900).select(
        F.floor(F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 13 % 101).cast("double")).alias("v"),
    ).withColumn("elev", F.col("row") * 3.0 + F.col("col") * 4.0)
    val = {(r["row"], r["col"]): r["v"] for r in px.collect()}
    got = focal.focal_mean(px, ["v"], 2.3, 1.0, tile=8).collect()
    assert len(got) == 900
    for r in got:
        near = [
            val.get((r["row"] + a, r["col"] + b))
            for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 2.3**2
        ]
        near = [v for v in near if v is not None]
        assert r["v_focal"] == pytest.approx(sum(near) / len(near))
    inner = focal.slope_percent(px, 1.0, tile=8).where("row between 1 and 28 and col between 1 and 28")
    assert inner.agg(F.min("slope_pct"), F.max("slope_pct")).first() == (pytest.approx(500), pytest.approx(500))


def test_split_lines_every_metre(spark):
    rows = [(1, 0, 0, 0, 0.0, 0.0, 2.5, 0.0), (1, 0, 0, 1, 2.5, 0.0, 2.5, 2.5)]
    out = lines.split_lines(frame(spark, rows), 2.0).orderBy("segment", "seq").collect()
    assert [(r["segment"], r["seq"], r["length"]) for r in out] == [(0, 0, 2.0), (1, 0, 0.5), (1, 1, 1.5), (2, 1, 1.0)]
    assert (out[2]["x2"], out[2]["y2"]) == (2.5, 1.5)


def test_running_length_over_chunks(spark):
    rows = [(1, 0, 0, i, float(i), 0.0, float(i + 1), 0.0) for i in range(25)]
    out = lines.running_length(frame(spark, rows), chunk=4).orderBy("seq").collect()
    assert [r["end"] for r in out] == [float(i + 1) for i in range(25)]


def test_eliminate_merges_chains_into_the_largest(spark):
    # one row of cells: sizes 1, 2, 3, 10, then a lone zone of 1 away from the others
    layout = [1] + [2] * 2 + [3] * 3 + [4] * 10 + [None] + [9]
    df = spark.createDataFrame([(0, c, z) for c, z in enumerate(layout)], "row int, col int, zone_id long")
    grid = Grid(cell=100.0)
    acre = 100 * 100 * geometry.ACRES_PER_M2
    out = lines.eliminate_small_zones(df, grid, min_acres=5 * acre)
    sizes = {r["zone_id"]: r["count"] for r in out.groupBy("zone_id").count().collect()}
    assert sizes == {4: 16, 9: 1}


def test_overlap_fraction_and_majority(spark):
    a = rasterize.polygon_spans(frame(spark, polygon(1, (0, 0, square(0, 0, 2))) + polygon(5, (0, 0, square(9, 9, 1)))), G5)
    b = rasterize.polygon_spans(frame(spark, polygon(2, (0, 0, square(1, 0, 4)))), G5)
    pairs = spark.createDataFrame([(1, 2), (5, 2)], "a_id long, b_id long")
    got = {r["a_id"]: r["fraction"] for r in overlap.min_overlap_fraction(pairs, a, b).collect()}
    assert got == {1: 0.5, 5: 0.0}
    with pytest.raises(ValueError, match="intersect"):
        overlap.lookup_region(
            rasterize.polygon_spans(frame(spark, polygon(7, (0, 0, square(0, 4, 1)))), G5), b.withColumnRenamed("feature_id", "region_id")
        )


def test_cell_lengths_add_up(spark):
    rows = [(1, 0, 0, 0, 0.3, 4.7, 4.6, 0.4)]
    out = lines.line_cell_lengths(frame(spark, rows), G5)
    assert out.agg(F.sum("length_m")).first()[0] == pytest.approx(math.hypot(4.3, 4.3))
    assert {(r["row"], r["col"]) for r in out.collect()} == {
        (r["row"], r["col"]) for r in rasterize.span_cells(rasterize.line_spans(frame(spark, rows), G5)).collect()
    }


def test_road_distance_reaches_every_cell(spark):
    grid = Grid(x0=0.0, y0=0.0, cell=30.0, nrows=150, ncols=330)
    roads = spark.createDataFrame([(1, 3, 15.0, -15.0, 75.0, -15.0), (2, 5, 9000.0, -2000.0, 9300.0, -2100.0), (3, 9, 5000.0, -3000.0, 5100.0, -3000.0)],
                                  "feature_id long, highway_code int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["row"], r["col"]): r["distance_m"] for r in distance.road_distance(roads, grid).collect()}
    marks = [k for k, v in got.items() if v == 0.0]
    assert len(got) == 150 * 330 and len(marks) > 10
    for row, col in [(0, 0), (149, 0), (149, 329), (75, 160), (0, 329), (100, 31)]:
        want = 30 * min(math.hypot(row - r, col - c) for r, c in marks)
        assert got[(row, col)] == pytest.approx(want)


def test_focal_windows_over_absent_cells(spark):
    rows = [(r, c, float(r * 3 + c), float((r * 7 + c * 5) % 11)) for r in range(9) for c in range(9) if (r * 5 + c * 3) % 4]
    have = {(r, c): (v, e) for r, c, v, e in rows}
    frame = spark.createDataFrame(rows, "row int, col int, v double, elev double")
    for r in focal.focal_mean(frame, ["v"], 60.0, 30.0, tile=4).collect():
        near = [have[(r["row"] + dr, r["col"] + dc)][0] for dr in range(-2, 3) for dc in range(-2, 3)
                if dr * dr + dc * dc <= 4 and (r["row"] + dr, r["col"] + dc) in have]
        assert r["v_focal"] == pytest.approx(sum(near) / len(near))
    out = {(r["row"], r["col"]): r["slope_pct"] for r in focal.slope_percent(frame, 30.0, tile=4).collect()}
    assert set(out) == set(have)
    for (r, c), slope in out.items():
        z = lambda dr, dc: have.get((r + dr, c + dc), have[(r, c)])[1]  # noqa: B023, E731
        dx = (z(-1, 1) + 2 * z(0, 1) + z(1, 1) - z(-1, -1) - 2 * z(0, -1) - z(1, -1)) / 240
        dy = (z(1, -1) + 2 * z(1, 0) + z(1, 1) - z(-1, -1) - 2 * z(-1, 0) - z(-1, 1)) / 240
        assert slope == pytest.approx(math.hypot(dx, dy) * 100)
