"""Exact overlay, repair, dissolve and offset on small figures, against plain Python."""

import math
import random

import pytest

from firegrid.operators import arrangement, offset, overlay, planar

EDGES = "feature_id int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def ring(feature, part, number, points):
    pairs = zip(points, points[1:] + points[:1])
    return [(feature, part, number, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(pairs)]


def box(x, y, width, height):
    return [(x, y), (x + width, y), (x + width, y + height), (x, y + height)]


def frame(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def areas(df, *keys):
    rows = planar.directed_areas(df, keys or ["feature_id"]).collect()
    return {r[0]: round(r["area_m2"], 6) for r in rows}


def star(draw, x, y, radius, n):
    """A simple polygon around a point; corners turn around it."""
    return [(x + radius * s * math.cos(a), y + radius * s * math.sin(a)) for a, s in ((2 * math.pi * i / n, draw.uniform(0.4, 1)) for i in range(n))]


def intervals(rows, x):
    """Signed intervals along an upright line, ring by ring."""
    out = []
    for key in {r[1:3] for r in rows}:
        ys = sorted(r[5] + (x - r[4]) / (r[6] - r[4]) * (r[7] - r[5]) for r in rows if r[1:3] == key and min(r[4], r[6]) < x < max(r[4], r[6]))
        out += [(1 if key[1] == 0 else -1, a, b) for a, b in zip(ys[::2], ys[1::2])]
    return out


def slab_area(left, right):
    """Area shared by two figures, from slabs without vertices or crossings inside."""
    xs = {v for r in left + right for v in (r[4], r[6])}
    for a in left:
        for b in right:
            (ax, ay, bx, by), (cx, cy, dx, dy) = a[4:], b[4:]
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
                if 0 < t < 1:
                    xs.add(ax + t * (bx - ax))
    xs, total = sorted(xs), 0.0
    for x0, x1 in zip(xs, xs[1:]):
        middle = (x0 + x1) / 2
        for s, a, b in intervals(left, middle):
            for z, c, d in intervals(right, middle):
                total += s * z * max(0.0, min(b, d) - max(a, c)) * (x1 - x0)
    return total


@pytest.mark.parametrize("tile", [3.3, 500.0])
def test_shared_areas_of_random_figures(spark, tile):
    draw = random.Random(4)
    left, right = [], []
    for i in range(6):
        x, y = draw.uniform(-20, 20), draw.uniform(-20, 20)
        left += ring(i, 0, 0, star(draw, x, y, 15, 9)[:: draw.choice((1, -1))]) + ring(i, 0, 1, box(x - 1, y - 1, 2, 2))
        right += ring(10 + i, 0, 0, star(draw, draw.uniform(-20, 20), draw.uniform(-20, 20), 12, 7))
    b = frame(spark, right).withColumnRenamed("feature_id", "region_id")
    got = {(r["feature_id"], r["region_id"]): r["area_m2"] for r in overlay.overlay_areas(frame(spark, left), b, tile).collect()}
    for i in range(6):
        for j in range(10, 16):
            expected = slab_area([r for r in left if r[0] == i], [r for r in right if r[0] == j])
            assert got.get((i, j), 0.0) == pytest.approx(expected, abs=1e-6)


def test_ties_slivers_and_touching_borders(spark):
    features = frame(spark, ring(1, 0, 0, box(0, 0, 10, 10)) + ring(2, 0, 0, box(0, 0, 10, 1e-3)) + ring(3, 0, 0, box(50, 50, 1, 1)))
    regions = ring(7, 0, 0, box(-5, 0, 10, 10)) + ring(5, 0, 0, box(5, 0, 10, 10)) + ring(9, 0, 0, box(10, 10, 5, 5)) + ring(8, 0, 0, box(10, 0, 5, 10))
    regions = frame(spark, regions).withColumnRenamed("feature_id", "region_id")
    got = {(r[0], r[1]): r[2] for r in overlay.overlay_areas(features, regions, 4.0).collect()}
    assert got == pytest.approx({(1, 5): 50, (1, 7): 50, (2, 5): 0.005, (2, 7): 0.005})
    assert {(r[0], r[1]) for r in overlay.dominant_region(features, regions, 4.0).collect()} == {(1, 5), (2, 5)}
    rows = overlay.assign_majority(features.select("feature_id").distinct(), features, regions, 4.0, thresh=0.3).collect()
    assert {r["feature_id"]: r["region_id"] for r in rows} == {1: 5, 2: None, 3: None}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 99)], "a_id int, b_id int")
    fractions = overlay.min_overlap_fraction(pairs, features, features, 4.0).collect()
    assert {(r[0], r[1]): round(r[2], 9) for r in fractions} == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0, (1, 99): 0.0}


def test_empty_layers(spark):
    nothing = frame(spark, [])
    some = frame(spark, ring(1, 0, 0, box(0, 0, 10, 10)))
    assert overlay.overlay_areas(some, nothing.withColumnRenamed("feature_id", "region_id"), 4.0).count() == 0
    assert arrangement.make_valid(nothing, 4.0).count() == 0
    assert arrangement.polygon_rings(arrangement.make_valid(nothing, 4.0), 4.0).count() == 0
    assert offset.offset_polygons(nothing, -1.0, 4.0).count() == 0


@pytest.mark.parametrize("tile", [3.3, 500.0])
def test_lengths_inside(spark, tile):
    polygons = planar.oriented(frame(spark, ring(1, 0, 0, box(0, 0, 10, 10)) + ring(1, 0, 1, box(4, 4, 2, 2))))
    lines = [(1, -5, 5, 20, 5), (2, 0, 0, 0, 10), (3, 10, 0, 10, 10), (4, 0, 10, 10, 10), (5, 0, 0, 10, 0), (6, 0, 0, 12, 12), (7, 11, 0, 30, 9), (8, 5, 1, 5, 1)]
    lines = spark.createDataFrame([(i, *map(float, c)) for i, *c in lines], "line int, x1 double, y1 double, x2 double, y2 double")
    got = {r["line"]: r["length_m"] for r in planar.lengths_inside(lines, polygons, tile, "line", "feature_id").collect()}
    # Borders belong to what is above them or on their right.
    assert got == pytest.approx({1: 8, 2: 10, 5: 10, 6: 8 * math.sqrt(2)})


FIGURES = {
    "bow-tie": (ring(1, 0, 0, [(0, 0), (10, 10), (10, 0), (0, 10)]), 50, [(0, 0), (1, 0)]),
    "hole along a side": (ring(1, 0, 0, box(0, 0, 10, 10)) + ring(1, 0, 1, box(0, 4, 2, 2)), 96, [(0, 0)]),
    "ring run through twice": (ring(1, 0, 0, box(0, 0, 10, 10)) + ring(1, 1, 0, box(0, 0, 10, 10)), None, []),
    "overlapping parts": (ring(1, 0, 0, box(0, 0, 10, 10)) + ring(1, 1, 0, box(5, 5, 10, 10)), 150, [(0, 0), (1, 0)]),
    "spike": (ring(1, 0, 0, [(0, 0), (10, 0), (10, 5), (20, 5), (10, 5), (10, 10), (0, 10)]), 100, [(0, 0)]),
    "hole touching in a vertex": (ring(1, 0, 0, box(0, 0, 10, 10)) + ring(1, 0, 1, [(0, 0), (5, 2), (2, 5)]), 89.5, [(0, 0)]),
    "island in a hole": (
        ring(1, 0, 0, box(0, 0, 30, 30)) + ring(1, 1, 0, box(5, 5, 20, 20)) + ring(1, 2, 0, box(10, 10, 5, 5)) + ring(1, 3, 0, box(40, 0, 3, 3)),
        900 - 400 + 25 + 9, [(0, 0), (0, 1), (1, 0), (2, 0)],
    ),
    "no area": (ring(1, 0, 0, [(0, 0), (5, 5), (9, 9)]), None, []),
    "crossing on a tile's border": (ring(1, 0, 0, [(0, 0), (10, 0), (10, 10), (7, 10), (7, 5), (0, 5)]) + ring(1, 1, 0, [(7, 5), (9, 5), (9, 2)]), 62, [(0, 0)]),
}


def test_make_valid(spark):
    rows = [(i, *r[1:]) for i, (own, _, _) in enumerate(FIGURES.values()) for r in own]
    for tile in (7.0, 10.0):
        repaired = arrangement.make_valid(frame(spark, rows), tile)
        assert areas(repaired) == {i: area for i, (_, area, _) in enumerate(FIGURES.values()) if area is not None}
    walked = arrangement.polygon_rings(repaired, 7.0).collect()
    for i, (name, (_, _, rings)) in enumerate(FIGURES.items()):
        assert sorted({(r["part"], r["ring"]) for r in walked if r["feature_id"] == i}) == rings, name
        for key in rings:
            own = sorted((r for r in walked if (r["feature_id"], r["part"], r["ring"]) == (i, *key)), key=lambda r: r["seq"])
            assert [r["seq"] for r in own] == list(range(len(own)))
            assert all((a["x2"], a["y2"]) == (b["x1"], b["y1"]) for a, b in zip(own, own[1:] + own[:1]))


def test_make_valid_of_random_curves(spark):
    """Closed curves that cross themselves a lot: the odd area does not depend on the tiles, and is right."""
    draw = random.Random(5)
    rows = []
    for i in range(4):
        rows += ring(i, 0, 0, [(draw.uniform(0, 50), draw.uniform(0, 50)) for _ in range(12)])
    got = [areas(arrangement.make_valid(frame(spark, rows), tile)) for tile in (6.0, 25.0)]
    assert got[0] == pytest.approx(got[1], abs=1e-3)
    for i in range(4):
        own = [r for r in rows if r[0] == i]
        # With itself crossed, slabs need its own crossings, which left and right provide.
        assert got[0][i] == pytest.approx(slab_area(own, own), abs=1e-2)


def test_dissolve(spark):
    rows = ring(1, 0, 0, box(0, 0, 10, 10)) + ring(2, 0, 0, box(10, 0, 10, 10)) + ring(3, 0, 0, box(5, 5, 10, 10)) + ring(4, 0, 0, box(100, 0, 10, 10))
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "feature_id int, type string")
    merged = arrangement.dissolve(frame(spark, rows), groups, 8.0)
    assert areas(merged, "type") == {"a": 250, "b": 100}
    rings = arrangement.polygon_rings(merged, 8.0, ["type"]).where("type = 'a'").orderBy("seq").collect()
    # The shared border is gone.
    assert not any(r["x1"] == r["x2"] == 10 for r in rings) and len(rings) == 9


def arc(d, quad_segs=16):
    """A quarter of the figure that stands for a circle."""
    return d * d * math.sin(math.pi / 2 / quad_segs) * quad_segs / 2


@pytest.mark.parametrize("tile", [5.0, 64.0])
def test_offsets_have_the_analytic_areas(spark, tile):
    rows = ring(1, 0, 0, box(0, 0, 20, 10)[::-1])
    rows += ring(2, 0, 0, [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)])
    rows += ring(3, 0, 0, box(0, 0, 20, 20)) + ring(3, 0, 1, box(8, 8, 4, 4))
    rows += ring(4, 0, 0, box(0, 0, 3, 3))
    rows += ring(5, 0, 0, [(0, 0), (10, 0), (10, 10), (13, 10), (13, 0), (23, 0), (23, 12), (0, 12)])
    rows += ring(6, 0, 0, [(0, 0), (5, 0), (10, 0), (10, 10), (0, 10)])
    shrunk = areas(offset.offset_polygons(frame(spark, rows), -2.0, tile))
    q = arc(2)
    expected = {1: 96, 2: 16 * 16 - 100 + 4 - q, 3: 256 - 16 - 32 - 4 * q, 5: 2 * 6 * 8, 6: 36}
    assert shrunk == pytest.approx(expected, abs=1e-5)
    grown = areas(offset.offset_polygons(frame(spark, rows), 2.0, tile))
    expected = {1: 200 + 120 + 4 * q, 2: 300 + 160 - 2 * 2 + 5 * q + 0.0, 3: 400 + 160 + 4 * q, 4: 9 + 24 + 4 * q, 6: 100 + 80 + 4 * q}
    # Around the L's inner corner the two strips overlap in a square of 2 m.
    assert {k: grown[k] for k in expected} == pytest.approx(expected, abs=1e-5)
    assert areas(offset.offset_polygons(frame(spark, rows), 0.0, tile))[2] == 300


def test_shrunk_units_of_an_area(spark):
    units = frame(spark, ring(1, 0, 0, box(0, 0, 10, 10)) + ring(2, 0, 0, box(10, 0, 10, 10)) + ring(3, 0, 0, box(40, 0, 10, 10)))
    # Two overlapping polygons; the second only reaches 1 m into unit 2.
    area = frame(spark, ring(1, 0, 0, box(-5, -5, 13, 30)) + ring(2, 0, 0, box(3, -5, 8, 30)))
    share = lambda **kw: {r[0]: round(r[1], 9) for r in overlay.extract_by_region(units, area, 6.0, **kw).collect()}
    assert share(thresh=None) == {1: 0.36}
    assert share(shrink_m=0.0) == {1: 1.0}


def test_pixels_agree(spark):
    """Random figures grown and shrunk, by the distance of points to the border."""
    draw = random.Random(8)
    points = star(draw, 0, 0, 30, 11)
    rows = ring(1, 0, 0, points)
    edges = [(r[4:6], r[6:8]) for r in rows]

    def distance(x, y):
        best = 1e9
        for (ax, ay), (bx, by) in edges:
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            best = min(best, math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y))
        odd = sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in edges) % 2
        return best if odd else -best

    step = 0.5
    grid = [distance(-36 + i * step, -36 + j * step) for i in range(145) for j in range(145)]
    for d in (-3.0, 3.0):  # a point of the grid stands for its cell
        got = areas(offset.offset_polygons(frame(spark, rows), d, 20.0))[1]
        assert got == pytest.approx(sum(v > -d for v in grid) * step * step, rel=0.01)


@pytest.mark.parametrize("s", [567, 980])
def test_overlap_that_meets_its_limit_exactly_counts(spark, s):
    """These suppliers' figures cover exactly 18,000 of the 900,000 square metres of the region that they share most with."""
    u, w = (s * 37) % 85 + 0.25, s * 3 // 2 + 0.25
    place = lambda corners: [((u + x) * 30, -(w + y) * 30) for x, y in corners]
    zone = ring(s, 0, 0, place([(0, 0), (4 + s % 7, s % 3), (3 + s % 9, 5 + s % 5), (s % 2, 4 + s % 4)]))
    zone += ring(s, 0, 1, place(box(1.5, 1.5, 1, 1)))
    regions = [e for r in range(160) for e in ring(r, 0, 0, [(x * 30, -y * 30) for x, y in box(r % 4 * 25, r // 4 * 40, 25, 40)])]
    edges, units = frame(spark, zone), frame(spark, regions).withColumnRenamed("feature_id", "region_id")
    out = overlay.assign_majority(edges.select("feature_id").distinct(), edges, units, 240.0, thresh=0.02).first()
    assert (out["region_id"], out["overlap_acres"]) == ({567: 86, 980: 146}[s], 18000 * 0.000247105)
