import random
from itertools import combinations

import pytest
from helpers import byte_words, doc, docs_frame, words

from firegrid.llm import jaccard
from firegrid.llm.common import Scratch
from firegrid.llm.components import connected_components


def shingles(text):
    own = byte_words((text or "").encode().lower().decode())
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def plain(rows):
    """(doc_id, set size, component) by all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return out


def copies(seed, n=40):
    """Groups of near copies around the threshold, with a common passage, long and short."""
    draw, rows = random.Random(seed), []
    common = words(seed, 25)
    for g in range(6):
        base = words(seed + 10 + g, draw.choice([7, 9, 12, 30, 80, 200]))
        if g % 2:
            base = base + common
        for _ in range(n // 6):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                copy[draw.randrange(len(copy))] = draw.choice("pqrs") * 4
            if draw.random() < 0.3:
                copy = copy[: -draw.randint(1, max(1, len(copy) // 5))]
            rows.append(doc(len(rows) * 3 + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize("options", [{}, {"border": 0}, {"border": 32}, {"border": 8, "hint_size": 10}])
def test_components_equal_all_pairs(spark, options):
    rows = copies(1) + [doc(1000 + r[0] if r[0] is not None else None, *r[1:2]) for r in docs_frame(spark).collect()]
    got = jaccard.jaccard_components(docs_frame(spark, rows), **options).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(doc_id={d}, n_shingles={n}, component_id={c})" for d, n, c in plain(rows)
    )


def test_a_large_group_of_near_copies(spark):
    draw, base, rows = random.Random(4), words(9, 120), []
    for i in range(220):
        copy = list(base)
        for _ in range(draw.randint(0, 5)):
            copy[draw.randrange(120)] = f"n{i}{draw.randrange(9)}"
        rows.append(doc(i, " ".join(copy)))
    got = jaccard.jaccard_components(docs_frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(rows))


def test_threshold_is_met_exactly(spark):
    """Three of four shingles shared links, less does not."""
    own = words(3, 9)
    rows = [doc(1, " ".join(own[:8])), doc(2, " ".join(own[:7])), doc(3, " ".join(own[1:6])), doc(4, " ".join(own[:4]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs_frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_one_row_per_component(spark):
    rows = docs_frame(spark).collect()
    frame = docs_frame(spark, [tuple(r) for r in rows])
    kept = jaccard.one_per_component(frame)
    assert kept.columns == frame.columns
    expected = {(c if n else d, n > 0) for d, n, c in plain([tuple(r) for r in rows])}
    got = [(r["doc_id"], bool(byte_words(r["text"]))) for r in kept.collect()]
    assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize("border", [0, 32])
def test_dense_lists_equal_all_pairs(spark, monkeypatch, border):
    """Lists that are paired by places and in blocks, beside others, lose no link."""
    monkeypatch.setattr(jaccard, "_BLOCK_MEMBERS", 4)
    rows, template = copies(2, 48), words(77, 60)
    for i in range(40):  # some link by the template, most do not; lengths differ
        rows.append(doc(5000 + i, " ".join(template[: 60 - i % 7] + words(900 + i % 30, 5 + i % 25))))
    got = jaccard.jaccard_components(docs_frame(spark, rows), border=border, dense=1).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(rows))


def test_many_unlinked_pages_of_one_template(spark):
    """All pairs of the template's lists would be hundreds of millions."""
    template = words(5, 200)
    rows = [doc(i, " ".join(template + [f"w{i}x{k}" for k in range(60)])) for i in range(12_000)]
    rows.append(doc(20_000, rows[7][1] + " more"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs_frame(spark, rows)).collect()}
    assert got == {r[0]: r[0] for r in rows} | {20_000: 7}


def test_null_and_repeated_ids_do_not_merge_components(spark):
    """Different texts without an id, and different texts of one id, each keep a row; their near copies go."""
    text = [words(300 + i, 60) for i in range(5)]
    near = [" ".join([*t[:-1], "zz"]) for t in text]
    full = [" ".join(t) for t in text]
    rows = [doc(None, full[0]), doc(None, full[1]), doc(None, near[1]), doc(None, full[1]), doc(7, full[2]), doc(7, full[3]), doc(9, near[3]), doc(8, full[4])]
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_per_component(docs_frame(spark, rows)).collect()), key=str)
    groups = [{full[0]}, {full[1], near[1]}, {full[2]}, {full[3], near[3]}, {full[4]}]
    assert [sum(t in g for _, t in kept) for g in groups] == [1] * 5 and len(kept) == 5
    assert {(7, full[2]), (7, full[3]), (8, full[4])} <= set(kept)


def test_empty(spark):
    assert jaccard.jaccard_components(docs_frame(spark, [])).count() == 0
    assert jaccard.one_per_component(docs_frame(spark, [])).count() == 0


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5), (20, 21), (21, 22), (500, 22), (501, 500)]
    random.Random(1).shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(frame, Scratch(spark)).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3} | {i: 20 for i in (20, 21, 22, 500, 501)}
    assert connected_components(frame.limit(0), Scratch(spark)).count() == 0
