from collections import Counter

import pytest
from helpers import byte_words, doc, docs_frame, words

from firegrid.llm.mixing import mix_sources, mixed_documents, source_targets


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_targets_and_takes(spark):
    frame = docs_frame(spark)
    rows = mix_sources(frame, block_words=4, shard_words=2000).collect()
    sizes = Counter()
    for r in frame.collect():
        sizes[r["source"]] += len(byte_words(r["text"]))
    targets, taken = plain_targets(sizes), Counter()
    assert len(rows) == frame.count()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 4
    again = mix_sources(frame.repartition(2), block_words=4, shard_words=2000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_capped_sources_reshare(spark):
    totals = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), ("d", 0, 1)], "source string, source_size long, n_rows long")
    got = {r["source"]: r["target"] for r in source_targets(totals).collect()}
    assert got == pytest.approx(plain_targets({"a": 10, "b": 1000, "c": 1000, "d": 0}))
    assert got["a"] == 20 and got["d"] == 0


@pytest.mark.parametrize("shard_words", [300, 1 << 16])
def test_highest_quotients(spark, shard_words):
    """A source's blocks are those of the highest quotients over its shards; the next shard takes the rest in words."""
    rows = [doc(i, " ".join(words(i, 20 + 7 * (i % 11) + (i % 3) * (i % 7) * 30)), "abc"[i % 3]) for i in range(120)]
    got = mix_sources(docs_frame(spark, rows), block_words=8, shard_words=shard_words, share=1.1).collect()
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        votes = Counter()
        for r in own:
            votes[r["shard"]] += r["size"]
        assert (len(votes) > 5) == (shard_words == 300)
        quota = round(own[0]["target"])
        quotients = sorted(((-v / (2 * k + 1), s, k) for s, v in votes.items() for k in range(quota // 8 + 1)))
        expected = Counter({s: 0 for s in votes})
        for _, s, _ in quotients[: quota // 8]:
            expected[s] += 8
        expected[quotients[quota // 8][1]] += quota % 8
        over = sum(max(0, n - 2 * votes[s]) for s, n in expected.items())
        for s in sorted(votes):  # what full shards can't take goes to the others in order
            expected[s] = min(expected[s], 2 * votes[s])
            more = min(over, 2 * votes[s] - expected[s])
            expected[s] += more
            over -= more
        assert {r["shard"]: r["shard_words"] for r in own} == dict(expected)
        assert sum(r["taken"] for r in own) == quota


def test_small_sources_and_many_almost_empty_rows(spark):
    """Sources of one to seven words take their target, as does one of which one row in fifty holds a word."""
    rows = [doc(i, " ".join(words(i, i + 1)), f"s{i}") for i in range(7)]
    rows += [doc(100 + i, "word" if i % 50 == 0 else None, "thin") for i in range(20_000)]
    rows += [doc(30_000 + i, " ".join(words(i, 30)), "wide") for i in range(100)]
    got = mix_sources(docs_frame(spark, rows), shard_words=5000).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= 1, source


def test_documents_of_the_mix(spark):
    frame = docs_frame(spark)
    mixed = mixed_documents(frame, block_words=4)
    assert mixed.columns == frame.columns
    taken, out = Counter(), Counter()
    for r in mix_sources(frame, block_words=4).collect():
        taken[r["source"]] += r["taken"]
    for r in mixed.collect():
        out[r["source"]] += len(byte_words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert out == Counter({k: v for k, v in taken.items() if v})


def test_empty(spark):
    frame = docs_frame(spark, [])
    assert mix_sources(frame).count() == 0 and mixed_documents(frame).count() == 0
    assert [r["taken"] for r in mix_sources(docs_frame(spark, [doc(1, None), doc(2, "")])).collect()] == [0, 0]
