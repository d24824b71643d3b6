"""Stages keep columns whose names the operators use themselves."""

import pytest
from helpers import awkward_rows

from firegrid.llm import jaccard, mixing, substring

NAMES = "_size _key _source _text _t0 _t _d _n _keep _spans _copied _text_hash copies others label n s shard _taken row_id a.b".split()
STAGES = {"near": jaccard.one_per_component, "repeats": substring.without_repeats, "mix": mixing.mixed_documents}


@pytest.mark.parametrize("stage", STAGES)
def test_columns_pass_unchanged(spark, stage):
    rows = [(*r[:5], *[f"{name}{i}" for name in NAMES]) for i, r in enumerate(awkward_rows())]
    own = [f"`{n}` string" for n in NAMES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(own))
    got = STAGES[stage](docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert found
    for row in found:
        values = row[5:]
        i = values[0].removeprefix("_size")
        assert list(values) == [f"{name}{i}" for name in NAMES]
        assert row[0] == rows[int(i)][0] and row[2:4] == rows[int(i)][2:4]


@pytest.mark.parametrize("stage", STAGES)
def test_only_the_needed_columns(spark, stage):
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in awkward_rows()], "doc_id long, text string, source string")
    assert STAGES[stage](docs).columns == docs.columns
    assert STAGES[stage](docs.limit(0)).count() == 0
