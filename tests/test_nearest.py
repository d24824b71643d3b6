"""Nearest lattice points and rank selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import quantiles, spatial_join

POINTS = "point_id int, lon double, lat double"
LATTICE = "gid int, lon double, lat double"


def nearest(points, lattice, k):
    out = set()
    for i, lon, lat in points:
        d = np.hypot(lattice[:, 1] - lon, lattice[:, 2] - lat)
        for rank, j in enumerate(np.lexsort((lattice[:, 0], d))[:k]):
            out.add((i, int(lattice[j, 0]), rank + 1, round(float(d[j]), 9)))
    return out


@pytest.mark.parametrize("k, width", [(1, 0.25), (9, 0.1)])
def test_far_and_near_points(spark, k, width):
    """A thousand points from inside the lattice to the other side of the globe, and two clusters of lattice points."""
    draw = np.random.default_rng(1)
    lattice = np.array([(40 * i + j, -110 + 0.05 * i, 36 + 0.05 * j) for i in range(40) for j in range(40)])
    far = [(2000 + i, -170 + draw.random(), 80 * draw.random()) for i in range(5)]
    lattice = np.concatenate([lattice, far])
    spread = 10.0 ** draw.uniform(-2, 2, 1000)
    points = [(i, float(np.clip(-109 + s * draw.standard_normal(), -179, 179)), float(np.clip(37 + s * draw.standard_normal(), -89, 89))) for i, s in enumerate(spread)]
    points += [(1000, -110.0, 36.0), (1001, -110.0, 36.0), (1002, -109.975, 36.025)]  # repeated places and ties
    got = spatial_join.nearest_grid_points(
        spark.createDataFrame([(i, x, y) for i, x, y in points], POINTS),
        spark.createDataFrame([(int(g), float(x + 360 if g % 2 else x), float(y)) for g, x, y in lattice], LATTICE), k, width,
    )
    rows = {(r["point_id"], r["rank"]): (r["gid"], r["distance_deg"]) for r in got.collect()}
    expected = nearest(points, lattice, k)
    assert len(rows) == len(expected)
    for i, gid, rank, d in expected:
        assert rows[i, rank][1] == pytest.approx(d, abs=1e-7)
    same = sum(rows[i, rank][0] == gid for i, gid, rank, _ in expected)
    assert same >= 0.98 * len(expected)  # equal distances may differ in their last digit


def test_no_points_and_small_lattices(spark):
    lattice = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], LATTICE)
    assert spatial_join.nearest_grid_points(spark.createDataFrame([], POINTS), lattice, 2).count() == 0
    lost = spark.createDataFrame([(1, None, 1.0), (2, 0.0, 0.0)], POINTS)
    assert {r["point_id"] for r in spatial_join.nearest_grid_points(lost, lattice, 2).collect()} == {2}
    with pytest.raises(ValueError, match="only 2"):
        spatial_join.nearest_grid_points(lost, lattice, 3)


@pytest.mark.parametrize("most_rows", [0, 40, 10**9])
def test_quantiles_need_no_particular_values(spark, most_rows):
    """Brackets are cut again and again where rows are many, whatever the values are like."""
    draw = np.random.default_rng(2)
    values = {
        "near": 1000 + draw.random(400) * 1e-9,
        "wide": 10.0 ** draw.uniform(-300, 300, 400) * draw.choice([-1, 1], 400),
        "ties": draw.integers(-2, 3, 400).astype(float),
        "ends": np.array([-np.inf, -0.0, 0.0, 5e-324, 1.0, np.inf]),
    }
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [(None, 1.0), (None, 4.0), ("near", None), ("near", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.2, 0.37, 0.5, 0.999, 1.0]
    out = quantiles.exact_quantiles(df, ["k"], {"v": F.col("v")}, probs, steps=16, most_rows=most_rows)
    got = {r["k"]: r["q"] for r in out.collect()}
    assert got[None] == pytest.approx(list(np.quantile([1.0, 4.0], probs)))
    for k in ("near", "wide", "ties"):
        assert got[k] == pytest.approx(list(np.quantile(values[k], probs)), rel=1e-12)
    assert got["ends"][0] == -np.inf and got["ends"][-1] == np.inf and got["ends"][1] == 0
