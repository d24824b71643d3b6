import zlib

import numpy as np
from helpers import DOCS, docs_frame, words

from firegrid.llm import quality


def corpus(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        own = words(i, 30 + i % 50)
        text = " ".join(own).capitalize() + "." if good else " ".join(w + "!!$" for w in own).upper()
        rows.append((i, text, "en", "a", len(text), -1, -2, -3, "x", -4))
        labels.append((i, int(good), 0))
    labels += [(5, None, 1), (None, 1, 0), (99_999, 0, 0), (6, 7, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(d, r) for d, r in got.items() if r["held_out"]]
    assert len(held) > 40 and np.mean([r["predicted"] == (d % 4 > 0) for d, r in held]) >= 0.98
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["predicted"]}


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(spark, 200)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (quality.score_documents(docs, x).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(first) == sorted(second)


def test_awkward_rows(spark):
    _, labels = corpus(spark, 100)
    frame = docs_frame(spark)
    got = quality.score_documents(frame, labels).collect()
    assert len(got) == frame.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(docs_frame(spark, []), labels).count() == 0
    alone = quality.score_documents(frame, labels.where("quality = 1")).collect()
    assert all(r["score"] == 1 for r in alone)


def test_pairs_teach_the_order():
    draw = np.random.default_rng(1)
    truth = np.array([2.0, -1.0, 0.0])
    x = draw.standard_normal((600, 3))
    good = x @ truth + draw.logistic(size=600) * 0.3 > 0
    weights = quality.bradley_terry(x[good], x[~good], 4000, 1)
    assert weights @ truth / np.linalg.norm(weights) / np.linalg.norm(truth) > 0.98
