import zlib
from collections import defaultdict

import numpy as np
from helpers import doc, docs_frame, words

from firegrid.llm import sharding
from firegrid.llm.common import Scratch


def test_places_and_checksums(spark):
    frame = docs_frame(spark)
    texts = defaultdict(list)
    for r in frame.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    rows = sharding.shard_by_slots(frame, shards=4, n_slots=64).collect()
    places = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert (r["size"], r["text_crc32"]) in [(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r["doc_id"]]]
        places[r["shard"]].append(r["slot"])
    assert len(rows) == frame.count()
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_near_equal_bytes_with_a_hot_group(spark):
    rows = [doc(i, "same text of many rows") for i in range(700)] + [doc(1000 + i, " ".join(words(i, 1 + i % 90))) for i in range(1400)]
    got = sharding.shard_by_slots(docs_frame(spark, rows)).groupBy("shard").agg({"size": "sum"}).collect()
    loads = [r["sum(size)"] for r in got]
    assert len(loads) == 16 and max(loads) - min(loads) <= 0.01 * np.mean(loads)


def test_map_versions_move_few_slots(spark):
    path = Scratch(spark).path("map")
    rows = [doc(i, " ".join(words(i, 1 + i % 50))) for i in range(3000)]
    size, _ = sharding.slot_totals(sharding.slotted(docs_frame(spark, rows)))
    sharding.store_map(spark, path, 0, sharding.first_map())
    first = sharding.shard_by_slots(docs_frame(spark, rows), map_path=path)
    version, owner = sharding.load_map(spark, path)
    assert version == 1 and first.select("map_version").distinct().collect()[0][0] == 1
    grown = rows + [doc(10_000 + i, " ".join(words(i, 30))) for i in range(300)]
    second = sharding.shard_by_slots(docs_frame(spark, grown), map_path=path)
    _, after = sharding.load_map(spark, path)
    assert second.count() == 3300
    assert (after != owner).mean() < 0.2
    assert (sharding.load_map(spark, path, 0)[1] == sharding.first_map()).all()
    loads = np.bincount(sharding.edited_map(sharding.first_map(), size), weights=size)
    assert loads.max() - loads.min() <= 0.01 * loads.mean()


def test_empty(spark):
    assert sharding.shard_by_slots(docs_frame(spark, [])).count() == 0
