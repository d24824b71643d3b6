import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import doc, docs_frame, words
from tokenizers import Tokenizer

from firegrid.llm import packing
from firegrid.llm.queries import tokenizer_path


@pytest.mark.parametrize("group_pieces", [50_000, 7])
def test_ids_cuts_and_places(spark, group_pieces):
    frame = docs_frame(spark)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = defaultdict(list)
    for r in frame.collect():
        ids[r["doc_id"]].append(np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4"))
    rows = packing.pack_documents(frame, tokenizer_path(), group_pieces=group_pieces).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    sequences = defaultdict(list)
    for r in rows:
        parts = [x[r["start"] : r["start"] + r["length"]] for x in ids[r["doc_id"]]]
        assert r["start"] == 4096 * r["piece"]
        assert (r["length"], r["ids_crc32"]) in [(len(p), zlib.crc32(p.tobytes())) for p in parts]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and sum(n for _, n in own) <= 4096
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    if group_pieces > 1000:
        assert len(sequences) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_ids_of_odd_chunks():
    """Chunks that are no word of Latin letters, and letters that change in lower case or when composed."""
    texts = ["", None, " ", "  a  b\t\nc\x0b\x0cd\r", "\u0130stanbul \u0130 ISTANBUL", "it's don't \u00c0\u00c9 \u023a\u2c65 \u01c4 \u01c5 \u017f \u00df \u1e9e",
             "e\u0301 ae\u0301a \u212b \ufb01", "a\u00a0b a\u2003b x\u3000y", "\u4e2d\u6587 test\u4e2d\u6587", 'x.. y,,!? #a a# a#b 1234 12a "q"', "''s 's", "a" * 5000,
             "<|endoftext|> a<|startoftext|>b </w>", "a\x1fb a\x85b a\x00b", "word&&& $%$ a|b|", "\u0661\u0662 \u00bd \U0001f600 a\U0001f600", "Caf\u00c9, caf\u00e9 CAF\u00c9!"]
    tokenizer, chunk_ids = Tokenizer.from_file(tokenizer_path()), packing.ChunkIds(tokenizer_path())
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    for own in (slice(None), slice(3, 9), slice(1, 2), slice(0, 0)):
        assert [x.tolist() for x in packing._ids(chunk_ids, pa.array(texts, pa.string())[own], 1)] == expected[own]
    again = [x.tolist() for x in packing._ids(chunk_ids, pa.array(texts * 40, pa.large_string()), 1)]
    assert again == expected * 40


def test_texts_take_little_memory_and_leave_none():
    """Millions of words of a batch are no Python objects, and a worker remembers no words."""
    draw = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    known = ["".join(w) for w in draw.choice(letters, (60_000, 6))]
    texts = pa.array([" ".join(known[i] for i in draw.integers(0, len(known), 50_000)) for _ in range(24)])
    chunk_ids = packing.ChunkIds(tokenizer_path())
    tracemalloc.start()
    try:
        assert sum(map(len, packing._ids(chunk_ids, texts, 1))) > 1_200_000
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 1_000_000 and peak < 50_000_000


def test_exchanges_reach_the_lower_bound():
    """Best fit needs three bins here; one-for-one and two-for-one exchanges need two."""
    lengths = np.array([5, 4, 3, 3, 3, 2])
    bins = packing.local_search([[0, 2], [1, 3, 5], [4]], lengths, 10)
    assert len(bins) == 2 and all(lengths[b].sum() <= 10 for b in bins)
    assert sorted(i for b in bins for i in b) == list(range(6))


def test_search_keeps_items_and_never_adds_bins():
    draw = np.random.default_rng(3)
    for _ in range(30):
        lengths = draw.integers(1, 100, 80)
        before = packing.best_fit(lengths, 100)
        n = len(before)
        after = packing.local_search([list(b) for b in before], lengths, 100)
        assert len(after) <= n and sorted(i for b in after for i in b) == list(range(80))
        assert all(lengths[b].sum() <= 100 for b in after)


def test_search_beats_best_fit_and_reaches_the_bound():
    """Two pieces a bin: exchanges need fewer bins than best fit in falling order. Many small pieces: exchanges alone
    bring best fit in the order of arrival to what that needs."""
    hard = np.random.default_rng(1).integers(1100, 2900, 2000)
    falling = lambda x: packing.best_fit(x, 4096, np.argsort(-x, kind="stable"))
    assert len(packing.fewest_bins(hard, 4096)) <= len(falling(hard)) - 3
    small = np.minimum(4096, np.random.default_rng(0).lognormal(5.3, 0.9, 43_000).astype(int) + 1)
    search = packing.SwapSearch(packing.best_fit(small, 4096), small, 4096)
    before = len(search.bins)
    assert len(search.run()) < before and search.exchanges > 100
    assert len(packing.fewest_bins(small, 4096)) <= min(len(falling(small)), -(-int(small.sum()) // 4096) + 1)


def test_a_stuck_giver_does_not_end_the_search():
    """The emptiest bin holds what nobody can take; the next one can still be emptied."""
    lengths = np.array([50, 20, 40, 45, 45, 80])
    bins = packing.local_search([[0], [1, 2], [3, 4], [5]], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(6)) and all(lengths[b].sum() <= 100 for b in bins)
    assert len(bins) == 3


def test_awkward_lengths():
    for lengths in ([], [4096], [4096] * 5, [1] * 5000, [1] * 5000 + [4095] * 40):
        lengths = np.array(lengths, np.int64)
        assert len(packing.fewest_bins(lengths, 4096)) == -(-int(lengths.sum()) // 4096)


def test_empty_and_reruns(spark):
    assert packing.pack_documents(docs_frame(spark, []), tokenizer_path()).count() == 0
    frame = docs_frame(spark, [doc(i, " ".join(words(i, 5 + i))) for i in range(50)])
    runs = [sorted(map(str, packing.pack_documents(f, tokenizer_path()).collect())) for f in (frame, frame.repartition(3))]
    assert runs[0] == runs[1]
