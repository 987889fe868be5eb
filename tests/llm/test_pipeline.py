import os
import subprocess
import sys

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from cauce.llm import langid, minhash  # noqa: E402
from cauce.llm.common import DOCUMENT_COLUMNS  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


@pytest.fixture(scope="module")
def sf_planted(spark, tmp_path_factory, sf_small):
    """documents of the small scale with copies, near copies, texts without letters and nulls planted."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    long = [r for r in rows if len(r[1].split()) > 150][:8]
    extra = [(10_000 + i, r[1].replace(" ", "  "), r[2], "src0", 1) for i, r in enumerate(long[:4])]
    extra += [(20_000 + i, r[1] + " tail", r[2], "src1", 1) for i, r in enumerate(long[4:])]
    extra += [(30_000, "123 456 !!", "en", "src2", 1), (30_001, None, None, None, None), (30_002, "", "en", None, 0), rows[0], rows[0]]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows + extra, docs.schema).write.parquet(f"{path}/documents.parquet")
    return path, rows, long


def test_stages_one_by_one(spark, sf_planted):
    path, rows, long = sf_planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = corpus_pipeline.materialise(stage(spark, docs, path), name)
        after = [r.asDict() for r in docs.collect()]
        if name != "bpe":
            assert docs.columns == DOCUMENT_COLUMNS
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            assert {r["doc_id"] for r in before} - ids >= {30_000, 30_001, 30_002}
            assert len(before) - len(after) <= 3 + 2
        if name == "exact_dedup":
            want = {(r["text"] or "").translate(WHITE) for r in before}
            assert len(after) == len(want) == len({r["text"].translate(WHITE) for r in after})
            assert all(10_000 + i in ids and r[0] not in ids for i, r in enumerate(long[:4]))  # the longer text stays
        if name == "near_dedup":
            assert all(20_000 + i not in ids for i in range(4)) and len(before) - len(after) >= 4
        if name == "mixing":
            assert sorted(map(str, before)) == sorted(map(str, after))
        if name == "bpe":
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert len(after) == len(before)


def test_run_and_rejections(spark, sf_planted):
    path, _, _ = sf_planted
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, path).count() > 150
    assert minhash.THRESHOLD == 0.8 and langid.UNKNOWN == "und"


def test_run_returns_the_schedule(spark, sf_planted):
    path, _, _ = sf_planted
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "source", "source_rank", "slot"]
    by_source, by_slot = {}, {}
    for r in sorted(out.collect(), key=lambda r: (r["slot"], r["source_rank"])):
        by_source.setdefault(r["source"] or "", []).append((r["source_rank"], r["slot"]))
        by_slot.setdefault(r["slot"], set()).add(r["source"])
    assert len(by_source) > 1 and all(len(s) == 1 for s in by_slot.values())
    root = {s: int(len(x) ** 0.5 * 1000) for s, x in by_source.items()}
    share = {s: max(1, 1000 * r // sum(root.values())) for s, r in root.items()}
    period = sum(share.values())
    for s, ranks in by_source.items():
        assert [r for r, _ in ranks] == list(range(1, len(ranks) + 1))
        for rank, slot in ranks:  # each block inside its window: less than one block from the target
            block = (rank - 1) // 8 + 1
            assert (block - 1) * period // share[s] <= slot < -(-block * period // share[s])


def test_empty_documents(spark, tmp_path, sf_small):
    schema = spark.read.parquet(f"{sf_small}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_library_works_without_the_corpus_operators():
    code = ("import sys, builtins; real = builtins.__import__\n"
            "def gone(name, *a, **k):\n"
            "    if name.startswith('cauce.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
            "    return real(name, *a, **k)\n"
            "builtins.__import__ = gone\n"
            "import __spark_entry__ as e\n"
            "assert 'pipeline' not in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())\n"
            "assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
