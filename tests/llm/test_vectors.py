import math
import random

import numpy as np
import pytest

from firegrid.llm.ann import nearest_by_collisions
from firegrid.llm.topk import SortedLists, exact_cell, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, score double, query_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", -1.0, 2) for i, v in rows], SCHEMA).repartition(3)


def vectors(n, d=16, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((8, d))
    x = centres[draw.integers(0, 8, n)] + draw.standard_normal((n, d)) * 0.7
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0] * 16), (5000, None), (5001, [nan] * 16), (5002, [1.0, inf] * 8), (5003, [None] * 16), (5004, []), (5005, [0.0] * 16), (5050, [2.0, 1.0])]


def plain(rows, k, every, score):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        query = min(v for i, v in usable if i == q)
        best = sorted((-s, i) for i, v in usable if i != q and (s := score(query, v)) is not None)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def product(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "shard": 40}])
def test_exact_products(spark, sizes):
    rows = vectors(400) + odd_rows() + [(500 + i, vectors(400)[7][1]) for i in range(30)] + [(450, [1.0] * 16)] * 2
    got = top_inner_products(frame(spark, rows), **sizes).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(rows, 5, 50, product))


def test_bounds_hold_at_every_depth():
    draw = np.random.default_rng(2)
    rows, queries = np.floor(draw.standard_normal((50, 6)) * 9), np.floor(draw.standard_normal((5, 6)) * 9)
    lists, exact = SortedLists(rows), queries @ rows.T
    for depth in (1, 5, 25, 49, 50):
        lower, upper = lists.bounds(queries, depth)
        assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower == exact).all() and (upper == exact).all()


def test_large_components_stay_exact():
    rows = np.array([[1e18, -3.0], [1e18, 5.0], [2.0, 2.0]])
    ids = np.array([1, 2, 3])
    got = exact_cell(2)(np.array([0]), np.array([[1e-3, 1e18]]), ids, rows)
    assert list(got[1]) == [2, 3]


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))
    if not a.any() or not b.any():
        return None
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("sizes", [{}, {"block": 4, "shard": 150}])
def test_recall_and_scores(spark, sizes):
    rows = vectors(1200, 48) + odd_rows()
    got = nearest_by_collisions(frame(spark, rows), **sizes).collect()
    expected = plain(rows, 5, 50, cosine)
    by_id = {i: v for i, v in rows if i is not None}
    assert len(got) == len(expected)
    for r in got:
        assert r["score"] == pytest.approx(cosine(by_id[r["query_id"]], by_id[r["vec_id"]]), abs=1e-12)
        assert r["vec_id"] != r["query_id"]
    hit = {(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i, _ in expected}
    assert len(hit) >= 0.9 * len(expected)
    for q in {r["query_id"] for r in got}:
        own = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [x[0] for x in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda x: (x[1], x[2]))


def test_copies_are_found_by_small_windows(spark):
    same = vectors(1, 48, 9)[0][1]
    rows = vectors(600, 48) + [(2000 + i, same) for i in range(100)]
    got = [r for r in nearest_by_collisions(frame(spark, rows)).collect() if r["query_id"] == 2050]
    assert [r["vec_id"] for r in got] == [2000, 2001, 2002, 2003, 2004]
    assert all(r["score"] == pytest.approx(1) for r in got)


@pytest.mark.parametrize("search", [top_inner_products, nearest_by_collisions])
def test_few_rows(spark, search):
    assert search(frame(spark, [])).count() == 0
    assert search(frame(spark, [(50, [1.0, 2.0])])).count() == 0
    assert [tuple(r)[:3] for r in search(frame(spark, [(50, [1.0, 2.0]), (51, [1.0, 3.0])])).collect()] == [(50, 1, 51)]
    assert search(frame(spark, [(1, [1.0, random.random()]), (2, [1.0, 2.0])])).count() == 0
