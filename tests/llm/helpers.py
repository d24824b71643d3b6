"""Small tables with every awkward case, and readings of results."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, label int, _s string, t long"


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n)]


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), -1, -2, -3, "x", -4)


def awkward_rows() -> list[tuple]:
    """Nulls, empty, blank and long texts, repeated rows, near copies, shared passages, small sets, clashing columns."""
    rows = [doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "one"), doc(5, "One two"), doc(6, "one TWO"), doc(None, " ".join(words(1, 60)))]
    base = words(2, 300)
    for i in range(6):
        copy = list(base)
        for k in range(i):
            copy[37 * k + 5] = f"edit{i}{k}"
        rows.append(doc(10 + i, " ".join(copy), "b"))
    passage = words(3, 50)
    for i in range(5):
        rows.append(doc(20 + i, " ".join(words(100 + i, 40) + passage + words(200 + i, 30)), ("a", "c", None, "b", "d")[i]))
    rows += [doc(30, " ".join(words(4, 45)), None)] * 3
    rows += [doc(31, " ".join(words(4, 45))), doc(32, "\n".join(words(4, 45)).upper())]
    rows.append(doc(40, " ".join(words(5, 40) * 3)))
    rows.append(doc(41, " ".join(words(6, 9000)), "b"))
    short = words(7, 12)
    rows += [doc(50 + i, " ".join(short[: 8 + i])) for i in range(5)]
    rows += [doc(60, "café ÉTÉ x <|endoftext|> don't 12345 \U0001f600"), doc(61, "café ÉtÉ x <|endoftext|> don't 12345 \U0001f600")]
    rows.append(doc(70, "x" * 30_000, "e"))
    return rows


def docs_frame(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOCS).repartition(5)


def byte_words(text):
    return (text or "").encode().split()
