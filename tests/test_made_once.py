"""Work that a plan must hold once, and character tests that are one look-up: each of these grew a query's time many times over."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprov.functions import features as FE
from textprov.functions import fixed_values as V
from textprov.functions import text as T
from textprov.operators import pairs as P
from textprov.plans import catalogue
from textprov.plans import detect as DET
from textprov.sources import records as REC

SF = "/root/testdata/sf0.001"


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def conditions(df) -> list[str]:
    """The plan from each filter on to the next node."""
    return [part.split("+- ")[0] for part in optimised(df).split("Filter ")[1:]]


def test_top_diagnostics_detect_once(spark):
    docs = spark.createDataFrame([(1, "Nothing here is longer than it should be. And one more sentence that goes on."), (2, "")], "doc_id long, text string")
    out = DET.top_diagnostics(DET.detect(docs), ["doc_id"])
    assert not [c for c in conditions(out) if "regexp" in c]
    assert optimised(out).count("md5(") == 2 and {r.doc_id for r in out.collect()} <= {1}


def test_version_pairs_detect_once(spark):
    assert not [c for c in conditions(catalogue.QUERIES["joi6_version_pairs"](spark, SF)) if "regexp" in c]
    docs = spark.createDataFrame([("a", 1, 0.9), ("a", 2, None), ("a", 3, 0.2), ("b", 4, 0.9), ("b", 5, None)], "title string, doc_id long, overall double")
    assert [tuple(r) for r in P.version_pairs(docs).collect()] == [("a", 2, 1, 3, 0.9, 0.2)]


def test_samples_are_cleaned_once(spark):
    rows = spark.createDataFrame([(1, "/data/CReD_paper_x.csv", " *一二三四五六七八。 short。abc def。", "0")], "row_id long, path string, text string, label string")
    out = REC.generator_samples(rows)
    assert not [c for c in conditions(out) if "\\x{4e00}" in c]
    assert [(r.sent_idx, r.text) for r in out.collect()] == [(0, "一二三四五六七八。")]
    paired = catalogue.QUERIES["src4_paired_samples"](spark, SF)
    assert not [c for c in conditions(paired) if "zh) AND" in c]


def test_fast_space_is_the_same_class(spark):
    every = spark.range(0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    got = every.filter(F.col("c").rlike(V.FAST_SPACE) != F.col("c").rlike(V.SPACE)).count()
    assert got == 0 and every.filter(F.col("c").rlike(V.FAST_SPACE)).count() == len(V.SPACE_CHARS)


def test_sentences_with_plain_runs(spark):
    old = r"(?s)(?:[^。？！…“「『]++|[“「『][^”」』]*+(?:[”」』]|\z))*+(?:[。？！]++|…++|\z)"
    old_segment = r"(?s)(?:[^。？！“「『]++|[“「『][^”」』]*+(?:[”」』]|\z))*+(?:[。？！]++|\z)"
    texts = ["", "。", "一，二；三。四！？五……六", "说“甲。乙『丙”丁。戊", "「没有完。还有", "ab 、。😀…😀！\n『x』：…。", "”」』。“", "﹏￼。、《甲》？"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for now, before in ((V.ZH_SENTENCE, old), (V.ZH_SEGMENT, old_segment)):
        a, b = rows.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (now, before)]).toPandas().T.values.tolist()
        assert [list(x) for x in a] == [list(x) for x in b]
        assert r"\x{3010}-\x{fefe}" in now


def test_character_counts_are_look_ups(spark):
    rows = spark.createDataFrame([("的了x，的！a.",), ("",), (None,)], "t string")
    out = rows.select(FE.punctuation_density("t").alias("p"), FE.function_word_density("t").alias("f"))
    assert "regexp" not in optimised(out)
    assert [tuple(r) for r in out.collect()] == [(3 / 8, 3 / 8), (0.0, 0.0), (None, None)]


def test_templates_ask_for_literals_first(spark):
    assert FE.needed_literals("在[^。，]{2,30}的背景下[，,]") == ["的背景下"]
    assert FE.needed_literals("助益|助力[^。，]{0,20}") == ["助益", "助力"]
    assert FE.needed_literals(r"\bdelve\b") is None and FE.needed_literals("[ab]") is None
    texts = ["综上所述，在发展的背景下，赋能他人。", "综上所述没有逗号的一句话", "不仅如此重要，更能提供", "it is worth noting that we delve", "什么也没有的一句话"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", F.transform(FE.template_hits("t"), lambda h: F.struct(h["pattern"], h["count"])).alias("h")).collect()
    for t, hits in found:
        patterns = V.TEMPLATES_ZH if spark.range(1).select(T.is_chinese(F.lit(t))).first()[0] else V.TEMPLATES_EN
        counts = spark.range(1).select(*[T.count_of(F.lit(t), "(?U)" + p).alias(str(i)) for i, (p, _, _) in enumerate(patterns)]).first()
        assert [tuple(h) for h in hits] == [(p, n) for (p, _, _), n in zip(patterns, counts) if n]


def test_matching_and_training_read_written_rows(spark):
    for name in ("joi4_best_match", "joi5_first_match", "lab5_training_set"):
        assert "Generate posexplode" not in optimised(catalogue.QUERIES[name](spark, SF)), name
