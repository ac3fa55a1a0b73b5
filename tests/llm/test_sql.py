"""Operators that SQL can express, against their SQL; and what the SQL's data does not hold."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from textprov.llm import queries as Q
from textprov.llm.chat import perspectives
from textprov.llm.decontaminate import contamination, decontaminated
from textprov.llm.line_dedup import deduplicated, document_lines, first_level, suffix_levels
from tools.check_oracle import TABLES, compare

from .conftest import LONG, PASSAGE, SF, WORDS


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    status, n, _, _, note = compare(spark, con, SF, name, Q.QUERIES[name], Q.SQL[name])
    assert status == "ok" and n > 0, note


# --- benchmark decontamination -----------------------------------------------------------------------------------

def test_contamination_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:17])), (2, "TWO"), (3, None), (4, ""), (None, "alpha0"), (5, "..."), (2, "two"), (6, "never seen here")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in contamination(odd, items).collect()}
    assert len(contamination(odd, items).collect()) == odd.count()
    one = rows[1, 82]
    assert one.n_hit == 12 and one.item_ids == ["1"] and [tuple(m) for m in one.matches] == [("1", 5, 0, 12)]
    assert rows[11, 80].item_ids == ["1"]
    assert rows[10, 2].item_ids == ["2"] and rows[10, 2].n_hit == 1 and len(rows[10, 2].matches) == 1
    assert rows[2, 0].n_hit == 0 and rows[5, 30_000].n_hit == 0
    kept = decontaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 6, 8, 12, 13, None}
    assert contamination(empty, items).count() == 0 and contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    assert sorted(contamination(odd, items, block_chars=10).select("doc_id", "n_words", "n_hit", "item_ids").collect(), key=str) == sorted(contamination(odd, items).select("doc_id", "n_words", "n_hit", "item_ids").collect(), key=str)


# --- line dedup --------------------------------------------------------------------------------------------------

def test_suffix_array_is_sorted(spark):
    """Ranks by the first 2, 4, ... lines order the suffixes as the ranks of single lines do."""
    texts = ["a\nb\na\nb\nc", "b\na\nb\na\nb", "a\nb\nc\nd", "a\na\na\na\na\na"]
    lines = document_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    levels = [{(r.d, r.i): r["rank"] for r in level.collect()} for level in suffix_levels(*first_level(lines), 4)]
    first = {(r.d, r.i): (r.k1, r.k2) for r in lines.collect()}
    names = sorted(set(first.values()))
    for k, level in zip((1, 2, 4), levels):
        prefix = {p: tuple(names.index(first[p[0], j]) for j in range(p[1], p[1] + k) if (p[0], j) in first) for p in first}
        shared = {p for p in prefix if sum(q == prefix[p] for q in prefix.values()) > 1}
        assert set(level) == shared
        for p in level:
            assert level[p] == sum(q < prefix[p] for q in prefix.values())


def test_line_dedup_cases(spark, odd, empty):
    out = {(r.doc_id, r.n_words): r for r in deduplicated(odd, removed="gone").collect()}
    rows = deduplicated(odd, removed="gone").select("doc_id", "text", "gone").collect()
    text = {r.doc_id: r.text for r in rows}
    assert len(rows) == odd.count() and out
    assert text[1] == PASSAGE + "\nend one" and text[7] == "end seven" and text[5] == LONG and text[6] == ""
    assert text[2] is None and text[3] == "" and text[4] == "   \n\t\n " and text[11] == "\n\n" + PASSAGE.upper()
    assert sum(r.gone for r in rows) == 2 and deduplicated(empty).count() == 0
    assert deduplicated(odd).columns == odd.columns


def test_maximal_runs_go_whole(spark):
    """Lines of a run that no least run starts or ends at go with it; shorter runs stay."""
    w = lambda n, k: " ".join(f"{WORDS[k]}{i}" for i in range(n))
    run = [w(30, 0), w(15, 1), w(1, 2), w(40, 3), w(3, 4)]
    rows = [(1, "\n".join(["x", *run, "y"])), (2, "\n".join(["z", *run, "w", w(30, 0)])), (3, "\n".join([w(30, 0), w(15, 1)])), (4, "\n".join([w(60, 5)] * 4))]
    text = {r.doc_id: r.text for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert text[1] == rows[0][1] and text[2] == "z\nw\n" + w(30, 0) and text[3] == rows[2][1] and text[4] == w(60, 5)


# --- chat formatting ---------------------------------------------------------------------------------------------

def test_chat_cases(spark):
    rows = [(1, 2, "bob", "hi"), (1, 1, "ann", None), (1, 1, None, "psst"), (1, None, "system", "rules"), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 0, "ann", "x")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("view", F.lit(1)).withColumn("place", F.lit("x")).withColumn("chunk", F.lit(2))
    got = {(r.conv_id, r.speaker): r for r in perspectives(talk).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = got[1, "ann"]
    assert [(m.role, m.name, m.content, m.trained) for m in ann.messages] == [
        ("system", None, "rules", False), ("assistant", None, "", True), ("user", "unknown", "psst", False), ("user", "bob", "hi", False), ("assistant", None, "bye", True),
    ]
    trained, at = "", 0
    for m in ann.mask:
        trained += ann.text[at:at + m.length] if m.trained else ""
        at += m.length
    assert at == len(ann.text) and trained == "<|im_end|>\nbye<|im_end|>\n"
    assert len(got[None, "ann"].messages) == 2
    parts = perspectives(talk, chunk_turns=2).filter("conv_id = 1 and speaker = 'bob'").orderBy("chunk").collect()
    assert [p.chunk for p in parts] == [0, 1, 2] and "".join(p.text for p in parts) == got[1, "bob"].text
    assert perspectives(talk.limit(0)).count() == 0


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
