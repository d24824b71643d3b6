import math
from fractions import Fraction

import numpy as np
import pytest

from firegrid.llm import whitening
from firegrid.llm.queries import op13_polarisation_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, n int, deviation string, _place int, whitened array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", -1, "y", 2, [3]) for i, v in rows], SCHEMA).repartition(3)


def vectors(n, d=8, seed=1, spread=0.2):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d)) * spread @ draw.standard_normal((d, d)) + draw.standard_normal(d)
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def plain(rows, components=32):
    """By the definition, in fractions up to the eigenvectors."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in rows)
    x = [[math.floor(64 * c) + 1_000_000 for c in v + [0.0] * (width - len(v))] for _, v in rows]
    n = len(x)
    sums = [sum(r[a] for r in x) for a in range(width)]
    z = [[n * r[a] - sums[a] for a in range(width)] for r in x]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in z), n**3)) for b in range(width)] for a in range(width)])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    centred = np.array([[float(Fraction(c, n)) for c in r] for r in z])
    deviation = [sum(c * c for c in r) for r in z]
    return [i for i, _ in rows], n, deviation, centred @ axes / np.sqrt(np.maximum(e, 1e-300)), e / e.sum(), e


def check(spark, tmp_path, rows, real=None):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_polarisation_whitening(spark, str(tmp_path)).collect()
    ids, n, deviation, whitened, explained, _ = plain(rows)
    k = min(32, whitened.shape[1])
    real = k if real is None else real
    assert len(got) == k * len(ids)
    key = lambda i, d: (i is None, i or 0, d)
    order = sorted(range(len(ids)), key=lambda j: key(ids[j], deviation[j]))
    table = {}
    for r in got:
        table.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(explained[r["component"] - 1] if r["component"] <= real else 0, rel=1e-9, abs=1e-13)
    for c, own in table.items():
        own.sort(key=lambda r: key(r["vec_id"], r["deviation"]))
        assert [r["vec_id"] for r in own] == [ids[j] for j in order]
        assert [r["deviation"] for r in own] == [deviation[j] for j in order]
        if c > real:
            assert all(r["whitened"] is None for r in own)
            continue
        a, b = np.array([r["whitened"] for r in own]), whitened[order, c - 1]
        assert np.allclose(a, b * np.sign(a @ b), rtol=1e-7, atol=1e-7)
    return got


def test_equals_the_definition(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = vectors(300) + [(7, None), (8, [nan] * 8), (9, [inf] + [0.0] * 7), (10, [None] * 8), (None, [1.5] * 8), (400, [2.0, -1.0]), (401, [])]
    rows += [rows[5]] * 3
    check(spark, tmp_path, rows)


def test_more_dimensions_than_components(spark, tmp_path):
    check(spark, tmp_path, vectors(150, 40))


def test_dimensions_without_variance(spark, tmp_path):
    rows = [(i, [*v[:3], 5.0, v[0]]) for i, v in vectors(120)]
    check(spark, tmp_path, rows, real=3)


def test_few_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [])])).count() == 0
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in got)


def test_no_offset_or_size_spoils_the_sums():
    """Covariances stay exact where doubles lose them: a huge offset, huge entries, many rows."""
    draw = np.random.default_rng(3)
    for top, offset in ((50, 10**15), (2**40, 0), (3, 7)):
        x = draw.integers(-top, top, (60, 5)) + offset
        n, *sums = whitening.column_sums(x)
        centre = [(2 * s + n) // (2 * n) for s in sums]
        squares = whitening.polarised_sums(x, np.array(centre))
        _, exact = whitening.variances_to_covariance(n, sums, squares, centre)
        z = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
        assert exact == [[Fraction(2 * sum(r[a] * r[b] for r in z), n) for b in range(5)] for a in range(5)]
        fitted = whitening.Whitening(n, 5, sums, np.array(centre), np.eye(5), np.ones(5), np.ones(5))
        assert fitted.deviations(x) == [sum(v * v for v in r) for r in z]


def test_huge_entries_count_as_the_limit(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 6 and all(r["deviation"] > 0 for r in got)
