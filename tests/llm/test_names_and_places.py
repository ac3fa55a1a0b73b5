"""Columns whose names the operators use themselves, sums in the highest bit, and executors without this package."""

import os
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from textprov.llm.common import free_names
from textprov.llm.fingerprint import _LOW, EXACT, WORDS, added, removed
from textprov.llm.jaccard_join import one_of_each
from textprov.llm.line_dedup import deduplicated

from .conftest import PASSAGE, SF

OWN = ["_cut_id", "_cut_hash", "_cut_runs", "_cut_lines", "cut_id", "CUT_RUNS", "cut_lines", "_removed", "removed", "_gone_id", "_gone_key", "gone_id", "gone_hash", "text_key", "nth", "_gone_nth"]


@pytest.fixture(scope="module")
def clashing(odd):
    have = {c.lower() for c in odd.columns}
    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in OWN if c.lower() not in have])


def others(df):
    names = [c for c in df.columns if c not in ("text", "n_chars")]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_free_names(spark):
    df = spark.createDataFrame([], "A int, _a int, b int")
    assert free_names(df, "a", "b", "c", "c") == ["__a", "_b", "c", "_c"]


def test_line_dedup_keeps_columns_of_its_own_names(clashing):
    out = deduplicated(clashing)
    assert out.columns == clashing.columns and others(out) == others(clashing)


def test_one_of_each_keeps_columns_of_its_own_names(spark, clashing):
    out = one_of_each(clashing)
    assert out.columns == clashing.columns
    left = others(out)
    assert set(left) <= set(others(clashing))
    assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=str) == sorted([1, 2, 3, 4, 5, 8, 9, 9, 12, 13, None, None], key=str)
    rows = [(1, PASSAGE, k, {"k": k}) for k in (3, 1, 2)]
    kept = {one_of_each(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, k int, m map<string,int>").repartition(k + 1)).first().k for k in range(3)}
    assert len(kept) == 1  # the same of its repeated rows, in whatever order they come


@pytest.mark.parametrize("which", ["clashing", "empty", "plain"])
def test_stages_of_odd_tables(request, spark, clashing, empty, which):
    """Every stage works on tables without n_chars, with columns of its own names, with nulls, and on none."""
    docs = {"clashing": clashing, "empty": empty, "plain": clashing.select("doc_id", "text")}[which]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), "odd-stage")
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        if name != "sentencepiece encoding":
            assert out.columns == docs.columns
            docs = out
    assert which == "empty" or {2, 3, 4, 8, 9, 12, 13} <= {r.doc_id for r in out.select("doc_id").collect()}


def test_added_in_the_highest_bit(spark):
    top, full = 1 << 62, (1 << 63) - 1
    pairs = [(0, 0), (top, 0), (top, top), (full, 0), (full, 1), (full, full), (top | 5, top - 3), (3, full - 2)]
    a = [*[7] * EXACT, 1, *([0] * WORDS)]
    for x, y in pairs:
        p, q = [*a[:EXACT + 1], *[x] * WORDS], [*[_LOW] * EXACT, 1, *[y] * WORDS]
        row = spark.createDataFrame([(p, q)], "p array<bigint>, q array<bigint>").select(added("p", "q").alias("s"), removed(added(F.col("p"), F.col("q")), F.col("q")).alias("back")).first()
        assert list(row.s) == [*[6] * EXACT, 2, *[(x + y) & full] * WORDS] and list(row.back) == p


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The package is on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
sys.path.insert(0, {root!r})
def lost(batches):
    try:
        import textprov
    except ImportError:
        textprov = None
    for b in batches:
        yield b if textprov is None else b.slice(0, 0)
assert spark.range(1).mapInArrow(lost, "id bigint").count() == 1, "the workers found the package"
from textprov.llm.decontaminate import contamination, decontaminated
from textprov.llm.toxicity import accepted, fit, scores
words = [f"w{{i}}" for i in range(40)]
docs = spark.createDataFrame([(i, " ".join(words[i:] + ["awful"] * (i % 2) * 9)) for i in range(30)], "doc_id long, text string")
items = spark.createDataFrame([("a", " ".join(words[20:32]))], "item_id string, text string")
assert contamination(docs, items).filter("n_hit > 0").count() == 23
assert decontaminated(docs, items).count() == 7
labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
model = fit(docs, labels, least_z=1.0)
assert accepted(docs, model).count() == 15 and scores(docs, model).count() == 30
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH",) and not k.startswith("PYSPARK_GATEWAY")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "done" in out.stdout, out.stderr[-3000:]


def test_long_texts_have_the_buckets_of_short_ones(monkeypatch):
    """A text in pieces gives the buckets of all its n-grams, counted one by one; so do many texts in one slice."""
    import numpy as np

    from textprov.llm import toxicity as X

    rng = np.random.default_rng(3)
    monkeypatch.setattr(X, "SLICE_BYTES", 64)
    for n in (0, 1, 2, 3, 4, 5, 63, 64, 65, 67, 68, 69, 200, 1000):
        codes = rng.integers(97, 123, n).astype(np.uint32)
        want = sorted({int(b) for k in X.SIZES for i in range(n - k + 1) for size, bucket in X._ngrams(codes[i:i + k]) if size == k for b in bucket})
        row, bucket = X._present(codes, np.array([0, n]))
        assert bucket.tolist() == want and not row.any()
        twice, again = X._present(np.concatenate((codes, codes)), np.array([0, n, 2 * n]))
        assert again[twice == 0].tolist() == want and again[twice == 1].tolist() == want
        marked = np.zeros(X.BUCKETS, bool)
        marked[want[::2]] = True
        assert X._present(codes, np.array([0, n]), marked)[1].tolist() == want[::2]


def test_a_worker_gives_up_its_memos():
    from textprov.llm.bpe_memo import released, worker_memo

    first = worker_memo(("test", 1), lambda: [1])
    assert worker_memo(("test", 1), lambda: [2]) is first
    released()
    assert worker_memo(("test", 1), lambda: [2]) == [2]
    released()
