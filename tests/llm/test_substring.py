import hashlib
from collections import Counter

import pytest
from helpers import byte_words, doc, docs_frame, words

from firegrid.llm.substring import repeated_words, without_repeats


def plain(rows, window):
    own = [byte_words(r[1]) for r in rows]
    count = Counter(tuple(w[k : k + window]) for w in own for k in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, own):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out.append((r[0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def tangled():
    """Passages that branch, overlap, repeat inside a document and touch the ends."""
    a, b, c = words(1, 60), words(2, 50), words(3, 36)
    rows = [a + b, b + a, a[:40] + c + b[10:], c + c + c[:34], a[20:] + words(4, 5) + a[:34], ["x"] * 90, ["x"] * 34, ["x", "y"] * 40, b[:35], c[:34]]
    return [doc(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("window", [35, 4, 5])
def test_removed_words_equal_counted_windows(spark, window):
    rows = [tuple(r) for r in docs_frame(spark).collect()] + [(100 + r[0], *r[1:]) for r in tangled()]
    got = repeated_words(docs_frame(spark, rows), window).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, plain(rows, window)))


def test_rest_of_the_documents(spark):
    rows = tangled() + [doc(50, None), doc(51, ""), doc(52, " keeps \n its  space ")]
    frame = docs_frame(spark, rows)
    got = {r["doc_id"]: r for r in without_repeats(frame).collect()}
    assert without_repeats(frame).columns == frame.columns
    for d, n, removed, digest in plain(rows, 35):
        if n and n == removed:
            assert d not in got
        elif removed:
            assert hashlib.sha256(got[d]["text"].encode()).hexdigest() == digest and got[d]["n_chars"] == len(got[d]["text"])
        else:
            assert got[d]["text"] == next(r[1] for r in rows if r[0] == d)


def test_empty(spark):
    assert repeated_words(docs_frame(spark, [])).count() == 0 and without_repeats(docs_frame(spark, [])).count() == 0
