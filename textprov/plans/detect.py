"""Detection of whole documents: split, score, fuse, calibrate, find dense passages, judge.

A document stays one row from beginning to end; sentences and their scores are arrays in that row. The plan has no
shuffle, so hot documents or sources cannot skew it, and it scales with the number of input splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import sequences as S
from ..functions.features import template_names
from ..functions.scores import quality_gate, report_verdict, service_state, stand_in
from ..functions.text import let, main_language, service_sentences

NO_SENTENCES = "无可检测句子"


def stand_in_scorer(df: DataFrame) -> DataFrame:
    """Adds ``p_stat`` and ``p_deep`` arrays from the md5 stand-in; needs no model."""
    return df.withColumn("p_stat", F.transform("sents", lambda s: stand_in(s, 0))).withColumn(
        "p_deep", F.transform("sents", lambda s: stand_in(s, 1))
    )


def split_documents(docs: DataFrame, text: str = "text", splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``text_lang`` and the array ``sents``."""
    out = docs.withColumn("text_lang", main_language(text))
    return out.withColumn("sents", splitter(F.col(text)) if splitter else service_sentences(text, F.col("text_lang")))


def fuse_documents(scored: DataFrame, bias: float = V.FUSION_BIAS, english_model: bool = True,
                   isotonic: Callable[[Column], Column] | None = None, gate: bool = True) -> DataFrame:
    """Adds ``fused``, ``island`` (mean of the densest window, its start), ``final`` scores and ``overall``.

    English documents with an English model of their own leave the deep stream out. Islands are looked for on the raw
    fused scores, before isotonic calibration and the document gate.
    """
    deep = F.col("p_deep")
    if english_model:
        deep = F.when(F.col("text_lang") != "en", deep)
    out = scored.withColumn("lens", F.transform("sents", lambda s: F.length(s).cast("bigint")))
    out = out.withColumn("p_deep", deep).withColumn("fused", S.fuse_arrays(F.col("p_stat"), F.col("p_deep"), bias))
    out = out.withColumn("island", S.best_window(S.window_means(F.col("fused"))))
    cal = F.transform("fused", isotonic) if isotonic else F.col("fused")
    out = out.withColumn("final", S.gate_array(cal) if gate else cal)
    return out.withColumn("overall", S.char_weighted(F.col("final"), F.col("lens")))


def _top_sentences(top_k: int, limit: float) -> Column:
    ranked = F.slice(F.sort_array(F.transform("final", lambda p, i: F.struct((-p).alias("q"), i.alias("i")))), 1, top_k)
    kept = F.filter(ranked, lambda r: -r["q"] >= limit)

    def detail(final: Column, sents: Column, stat: Column, deep: Column, start: Column) -> Column:
        return F.transform(
            kept,
            lambda r: F.struct(
                r["i"].alias("sent_idx"),
                F.substring(F.get(sents, r["i"]), 1, 200).alias("sentence"),
                F.round(-r["q"], 4).alias("ai_prob"),
                template_names(F.get(sents, r["i"])).alias("templates"),
                F.round(F.get(stat, r["i"]), 4).alias("stat_prob"),
                F.round(F.get(deep, r["i"]), 4).alias("deep_prob"),
                F.round(S.neighbourhood(final, r["i"]), 4).alias("neighborhood_mean"),
                ((start >= 0) & (start <= r["i"]) & (r["i"] < start + V.ISLAND_WIDTH)).alias("in_ai_island"),
                (F.round(S.neighbourhood(final, r["i"]), 4) < 0.35).alias("isolated"),
            ),
        )

    return let(
        F.struct("final", "sents", "p_stat", "p_deep", F.col("island.start").alias("start")),
        lambda d: detail(d["final"], d["sents"], d["p_stat"], d["p_deep"], d["start"]),
    )


def report(fused: DataFrame, ids: list[str], text: str = "text", top_k: int = 20,
           limit: float = V.AI_SENTENCE_LIMIT) -> DataFrame:
    """One report row per document; documents without sentences keep their row with ``error`` set."""
    n = F.size("sents")
    found = n > 0
    hit = F.zip_with("final", "lens", lambda p, c: F.when(p >= limit, c).otherwise(F.lit(0).cast("bigint")))
    return fused.select(
        *ids,
        F.when(~found, NO_SENTENCES).alias("error"),
        F.when(found, F.round("overall", 4)).alias("overall_ai_prob"),
        F.when(found, F.round(F.col("overall") * 100, 1)).alias("ai_feature_rate"),
        F.when(found, F.round(S.mean(F.col("p_stat")), 4)).alias("stat_prob"),
        F.when(found, F.round(S.mean(F.col("p_deep")), 4)).alias("deep_prob"),
        n.cast("bigint").alias("n_sentences"),
        F.length(text).cast("bigint").alias("total_chars"),
        F.aggregate(hit, F.lit(0).cast("bigint"), lambda a, c: a + c).alias("ai_chars"),
        F.size(F.filter("final", lambda p: p >= limit)).cast("bigint").alias("ai_sentence_count"),
        F.when(found, F.round("island.best", 6)).alias("island_mean"),
        F.when(found, F.col("island.start")).cast("bigint").alias("island_start"),
        F.when(found, service_state(F.col("overall"), F.col("island.best"))).alias("state"),
        F.when(found, report_verdict("overall")).alias("verdict"),
        _top_sentences(top_k, limit).alias("top_ai_sentences"),
    )


def detect(docs: DataFrame, ids: list[str] | None = None, text: str = "text",
           scorer: Callable[[DataFrame], DataFrame] = stand_in_scorer, top_k: int = 20, **options) -> DataFrame:
    """Detection report of every document of a DataFrame; a batch is simply a DataFrame with more rows."""
    ids = ids or ["doc_id"]
    slim = docs.select(*ids, text)
    return report(fuse_documents(scorer(split_documents(slim, text)), **options), ids, text, top_k)


def top_diagnostics(reports: DataFrame, ids: list[str]) -> DataFrame:
    """One row for each entry of ``top_ai_sentences``.

    The outer form with a filter behind it: for the inner one the optimiser asks first whether the array has entries, and
    that question, carried down to the scan, holds the whole detection dozens of times.
    """
    return reports.select(*ids, F.inline_outer("top_ai_sentences")).filter(F.col("sent_idx").isNotNull())


def detect_batch(paths: DataFrame | None = None, texts: DataFrame | None = None, **options) -> DataFrame:
    """Mixed batch: ``paths(path, text)`` where a missing text is a read error, and ``texts(text)``.

    Every item gets a row; errors stay with their item.
    """
    parts = []
    if paths is not None:
        parts.append(paths.select("path", "text", F.when(F.col("text").isNull(), "文件不存在").alias("read_error")))
    if texts is not None:
        parts.append(texts.select(F.lit(None).cast("string").alias("path"), "text", F.lit(None).cast("string").alias("read_error")))
    if not parts:
        raise ValueError("paths or texts is needed")
    batch = parts[0]
    for p in parts[1:]:
        batch = batch.unionByName(p)
    batch = batch.withColumn("text_snippet", F.when(F.col("path").isNull(), F.substring("text", 1, 50)))
    batch = batch.withColumn("text", F.coalesce("text", F.lit("")))
    out = detect(batch, ids=["path", "text_snippet", "read_error"], **options)
    return out.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")


def templated_sentences(docs: DataFrame, ids: list[str] | None = None, text: str = "text") -> DataFrame:
    """Every sentence with a template phrase, whatever its score; text cut to 120 characters."""
    ids = ids or ["doc_id"]
    rows = docs.select(*ids, F.posexplode(service_sentences(F.col(text))).alias("sent_idx", "sentence"))
    return (
        rows.withColumn("templates", template_names("sentence"))
        .filter(F.size("templates") > 0)
        .withColumn("first_template", F.get("templates", F.lit(0)))
        .withColumn("sentence", F.substring("sentence", 1, 120))
    )


def quality_check(docs: DataFrame, threshold: float = 0.35, **options) -> DataFrame:
    """Pass/fail per document against a score threshold; documents that cannot be scored are errors."""
    out = detect(docs, **options)
    gate = F.when(F.col("error").isNull(), quality_gate("overall_ai_prob", threshold)).otherwise("error")
    return out.withColumn("gate", gate)
