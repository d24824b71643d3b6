import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.llm import negatives
from firegrid.llm.common import Scratch
from firegrid.llm.queries import OP12_SQL, op12_zone_map_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, place int, chunk int, block string, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "y", -1.0, 3) for i, v, label in rows], SCHEMA).repartition(3)


def vectors(n, d=16, seed=1, centres=8, noise=0.2):
    draw = np.random.default_rng(seed)
    middle = draw.standard_normal((centres, d))
    near = draw.integers(0, centres, n)
    x = middle[near] + draw.standard_normal((n, d)) * noise
    return [(i, [float(np.float32(c)) for c in row], int((c + draw.integers(0, 2)) % 5)) for i, (row, c) in enumerate(zip(x, near))]


def plain(rows, every=100, positives=5, k=10):
    end = 2**63 - 1
    usable = [(i, [math.floor(256 * float(c)) for c in v], label) for i, v, label in rows if usable_row(i, v, label)]
    product = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -end), end)
    out = []
    for anchor in sorted({i for i, _, _ in usable if i % every == 0}):
        label, vector = min((label, v) for i, v, label in usable if i == anchor)
        scored = sorted((-product(vector, v), i, other == label) for i, v, other in usable if i != anchor)
        for s, positive, _ in [x for x in scored if x[2]][:positives]:
            inside = [(t, i) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(anchor, positive, r + 1, i, -s, -t) for r, (t, i) in enumerate(inside)]
    return out


def usable_row(i, v, label):
    return None not in (i, v, label) and all(c is not None and math.isfinite(c) for c in v)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0] * 16, 1), (5000, None, 1), (5100, [nan] * 16, 1), (5200, [1.0, inf] * 8, 1), (5300, [None] * 16, 2), (5400, [], 1)]
    return rows + [(5500, [0.0] * 16, 2), (5600, [2.0, 1.0], 3), (5700, [1.0] * 16, None), (5800, [1.0] * 16, 77)]


@pytest.mark.parametrize("block", [256, 16])
def test_equals_brute_force(spark, block):
    rows = vectors(900) + odd_rows()
    rows += [(6000 + i, rows[300][1], i % 3) for i in range(60)]  # ties
    rows += [rows[200], rows[200], (400, [0.5] * 16, 1), (17, [1.0] * 16, 2)]  # repeated rows and ids
    got = negatives.hard_negatives(frame(spark, rows), block=block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows))


def test_huge_components(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [1e18, 2.0], 2), (3, [1e-20, 1.0], 2), (4, [-1e30, 1.0], 2), (100, [1e9, 1e9], 1), (5, [8e8, 8e8], 2)]
    rows += [(6, [1e9, 0.9e9], 1), (7, [0.3e9, 1e9], 2)]
    got = negatives.hard_negatives(frame(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows))


def test_few_rows(spark):
    search = lambda rows: negatives.hard_negatives(frame(spark, rows)).count()
    assert search([]) == 0
    assert search([(100, [1.0], 1)]) == 0
    assert search([(1, [1.0], 1), (2, [1.0], 2)]) == 0
    assert search([(100, [1.0], 1), (2, [1.0], 1), (3, [0.5], 2), (4, [2.0], 2)]) == 1
    assert search([(100, [], 1), (2, [], 1), (3, [], 2)]) == 1


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = vectors(600, 16, 5) + odd_rows()[:5]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_zone_map_negatives(spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = own.execute(f"SELECT {', '.join(got.columns)} FROM ({OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected) and expected


def test_bounds_hold():
    draw = np.random.default_rng(2)
    rows, anchors = np.floor(draw.standard_normal((40, 6)) * 300), np.floor(draw.standard_normal((9, 6)) * 300)
    lower, upper = negatives.interval_bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    exact = anchors @ rows.T
    assert (lower[:, 0] <= exact.min(axis=1)).all() and (exact.max(axis=1) <= upper[:, 0]).all()


def test_curve_visits_every_cell_by_neighbours():
    for d, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[range(2**bits)] * d, indexing="ij")).reshape(d, -1).T
        keys = negatives.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(keys)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_leave_most_blocks_unread(spark):
    """Clustered vectors: an anchor's windows read few of the blocks, and find all the same."""
    rows = [(i, v, label) for i, v, label in vectors(6000, 8, 4, centres=40, noise=0.03)]
    scratch = Scratch(spark)
    got = negatives.hard_negatives(frame(spark, rows), block=32, scratch=scratch)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows))
    blocks = spark.read.parquet(scratch.path("blocks")).count()
    for name, share in (("positives", 0.35), ("negatives", 0.6)):
        read = spark.read.parquet(scratch.path(f"{name}_chosen")).agg(F.sum(F.octet_length("anchors") / 4)).first()[0]
        assert read < share * 60 * blocks, (name, read / (60 * blocks))


def test_best_in_windows_against_sorting():
    draw = np.random.default_rng(6)
    scores = draw.integers(0, 9, (20, 50)).astype(np.float32)
    allowed, ids = draw.random((20, 50)) < 0.7, draw.permutation(50)
    least, most = draw.integers(0, 5, 20), draw.integers(3, 9, 20)
    window, row = negatives.best_in_windows(scores, allowed, ids, least, most, 4)
    found = defaultdict(list)
    for w, r in zip(window, row):
        found[w].append(ids[r])
    for w in range(20):
        inside = sorted((-scores[w, r], ids[r]) for r in range(50) if allowed[w, r] and least[w] <= scores[w, r] <= most[w])
        assert found[w] == [i for _, i in inside[:4]]
