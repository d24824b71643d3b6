import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from firegrid.llm import bpe
from firegrid.llm.queries import RANKS, op11_backtracking_bpe

from helpers import awkward_rows, docs_frame

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = bpe.vocabulary(PATH).ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


def odd_texts(n=3000):
    draw = random.Random(1)
    parts = ["a", "b", "e", "th", "x", " ", "  ", "\n", "\t", "é", "你好", "'s", "'", "1", "23", ".", "!!", " ", "\U0001f600", "the", "́", "\x00", " ", "<|endoftext|>"]
    for _ in range(n):
        yield "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
    for _ in range(50):
        yield "".join(draw.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(2000))
    for part in ("a", "ab", "aaab", "é", " ", "1", "你"):
        yield from (part * n for n in (2, 17, 100, 3000))


def test_texts_equal_the_library(library):
    encode = bpe._encoder(PATH, PATTERN)
    for text in odd_texts():
        assert ids(encode(text)) == library(text), text


def test_small_vocabularies_equal_plain_merges():
    """Vocabularies whose tokens overlap a lot; tokens that no merge of older ones makes are refused."""
    draw, tried = random.Random(2), 0
    while tried < 40:
        ranks = {b"a": 0, b"b": 1, b"c": 2}
        while len(ranks) < 25:
            new = draw.choice([*ranks]) + draw.choice([*ranks])
            if new in ranks or len(new) > 8:
                continue
            if plain_merges(ranks | {new: len(ranks)}, new) == [len(ranks)]:
                ranks[new] = len(ranks)
            else:
                with pytest.raises(ValueError, match="no merge"):
                    bpe.Vocabulary(ranks | {new: len(ranks)})
        tried += 1
        own = bpe.Vocabulary(ranks)
        for _ in range(150):
            data = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 30)))
            assert own.encode(data) == plain_merges(ranks, data), (ranks, data)


def plain_merges(ranks, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_long_texts_are_split_where_matches_end():
    find = regex.compile(PATTERN).findall
    draw = random.Random(3)
    for text in odd_texts(300):
        assert sum(bpe.split_text(find, text, draw.randint(1, 30)), []) == find(text)
    assert list(bpe.split_text(find, "")) == []


def test_one_long_match_takes_linear_time():
    encode = bpe.vocabulary(PATH).encode
    start = time.perf_counter()
    assert len(encode(b"abcdefgh" * 50_000)) > 0
    assert time.perf_counter() - start < 20


def test_awkward_rows(spark, library, tmp_path):
    rows = awkward_rows()
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_backtracking_bpe(spark, str(tmp_path)).collect()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    expected = []
    for row in rows:
        text = row[1] or ""
        own = library(text)
        expected.append((row[0] is None, row[0] or 0, len(own), sha(np.array(own, "<u4").tobytes()), sha(text.encode())))
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == sorted(expected)


def test_small_parts_and_null_ids(spark, monkeypatch):
    encoded = bpe.encode_texts(docs_frame(spark), PATH, PATTERN)
    whole = {(r["doc_id"], bytes(r["ids"])) for r in encoded.collect()}
    monkeypatch.setattr(bpe, "_OUT_BYTES", 1)
    parts = list(bpe._in_parts(iter(encoded.toArrow().to_batches()), "ids", ["doc_id", "ids"], lambda x: x.as_py()))
    assert {(r["doc_id"], r["ids"]) for p in parts for r in p.to_pylist()} == whole
    assert max(p.num_rows for p in parts) < 30
    nothing = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert sorted((r["doc_id"], r["decoded"]) for r in bpe.decode_ids(nothing, PATH).collect()) == [(1, None), (2, bytearray())]


def test_empty_table(spark):
    empty = bpe.encode_texts(docs_frame(spark).limit(0), PATH, PATTERN)
    assert bpe.decode_ids(empty, PATH).count() == 0
