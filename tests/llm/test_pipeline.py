import os
import subprocess
import sys
import zlib

import corpus_pipeline
import numpy as np
from helpers import docs_frame
from test_jaccard import plain as plain_components
from test_substring import plain as plain_removed
from tokenizers import Tokenizer

from firegrid.llm import common, mixing, packing, quality, substring
from firegrid.llm.common import Scratch
from firegrid.llm.queries import QUERIES, SQL, tokenizer_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


def test_each_stage_against_plain_python(spark):
    """Every stage's rows from the rows before it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = scratch.store(stage(spark, docs, DATA), name)
        after = [tuple(r) for r in out.collect()]
        ids = [r[0] for r in after]
        if name != "packing":
            assert out.columns == columns and 0 < len(after)
        if name == "quality":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            good = {r["doc_id"] for r in quality.score_documents(docs, labels).collect() if r["predicted"]}
            assert sorted(after) == sorted(r for r in before if r[0] in good)
            bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
            assert not bad & set(ids) and {r["doc_id"] for r in labels.where("quality = 1").collect()} <= set(ids)
        elif name == "near_duplicates":
            assert sorted(ids) == sorted({c for _, _, c in plain_components(before)})
            assert set(after) <= set(before)
        elif name == "substrings":
            expected = {d: n - removed for d, n, removed, _ in plain_removed(before, 35) if n > removed or not n}
            assert {r[0]: len((r[1] or "").encode().split()) for r in after} == expected
        elif name == "mixture":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect() if r["taken"]}
            got: dict[int, int] = {}
            for r in after:
                got[r[0]] = got.get(r[0], 0) + len(r[1].encode().split())
            assert got == taken
        else:
            tokenizer = Tokenizer.from_file(tokenizer_path())
            ids_of = [np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in before]
            pieces = [(r[0], k, zlib.crc32(x[at : at + 4096].tobytes())) for r, x in zip(before, ids_of) for k, at in enumerate(range(0, len(x), 4096))]
            assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in out.collect()) == sorted(pieces)
        docs = out


def test_workers_give_memory_back_after_texts(spark, monkeypatch):
    """Workers live on from stage to stage, so no task over texts may keep what it freed."""
    lean, given, made = common.lean, [], []
    frame = docs_frame(spark)
    plain = type(frame).mapInArrow
    for module in (substring, packing):
        monkeypatch.setattr(module, "lean", lambda task: made.append(lean(task)) or made[-1])
    monkeypatch.setattr(type(frame), "mapInArrow", lambda df, task, *args, **options: given.append(task) or plain(df, task, *args, **options))
    substring.without_repeats(frame)
    substring.repeated_words(frame)
    packing.token_pieces(frame, tokenizer_path())
    assert len(given) >= 7 and all(task in made for task in given)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_entry_without_the_package(tmp_path):
    """The other queries stand without the package and the pipeline."""
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "firegrid"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    os.mkdir(tmp_path / "firegrid")
    for name in os.listdir(f"{ROOT}/firegrid"):
        if name != "llm":
            os.symlink(f"{ROOT}/firegrid/{name}", tmp_path / "firegrid" / name)
    os.unlink(tmp_path / "workload")
    os.mkdir(tmp_path / "workload")
    for name in os.listdir(f"{ROOT}/workload"):
        os.symlink(f"{ROOT}/workload/{name}", tmp_path / "workload" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 140 and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
