"""Sentence pairs between versions of a document: version clusters, alignment, containment, filters, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import cosine
from ..functions.text import LENGTH_GAP, drop_space, has_page_header, is_contaminated, is_heading, length_ratio_ok, let, strip_space
from ..session import written
from .align import aligned

ORIGIN_ORDER = {"real": 0, "wechat_real": 1, "synth": 2}  # fixed values


# --- versions ----------------------------------------------------------------------------------------------------

def version_pairs(docs: DataFrame, title: str = "title", doc: str = "doc_id", score: str = "overall",
                  min_gap: float = 0.08) -> DataFrame:
    """Per title with two versions or more: the highest and the lowest scored document, if the gap is large enough.

    Only extreme values travel; a title with any number of versions is reduced before the shuffle. The earlier document
    wins a tie for the highest, the later one for the lowest.
    """
    one = F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("s"), (-F.col(doc)).alias("d")))
    top, low = F.max(one), F.min(one)
    # documents without a score are left out by the aggregates: a filter on it would be carried down to the scan, and make it twice
    out = docs.filter(F.col(title).isNotNull()).groupBy(title).agg(F.count(score).alias("n_versions"), top.alias("_hi"), low.alias("_lo"))
    return out.filter((F.col("n_versions") >= 2) & (F.col("_hi.s") - F.col("_lo.s") >= min_gap)).select(
        title, "n_versions",
        (-F.col("_hi.d")).alias("hi_doc"), (-F.col("_lo.d")).alias("lo_doc"),
        F.col("_hi.s").alias("hi_score"), F.col("_lo.s").alias("lo_score"),
    )


# --- alignment ---------------------------------------------------------------------------------------------------

def similar_sentences(src: DataFrame, tgt: DataFrame, threshold: float, pair: str = "pair_id", src_idx: str = "i",
                      tgt_idx: str = "j", sentence: str = "sentence") -> DataFrame:
    """All (pair, i, j) whose bigram Jaccard similarity reaches ``threshold``, with the similarity. Exact."""
    return aligned(src, tgt, threshold, pair, src_idx, tgt_idx, sentence)


def _pair_rows(best: DataFrame, src: DataFrame, tgt: DataFrame, pair: str) -> DataFrame:
    s = src.select(pair, "i", F.col("sentence").alias("src_ai"), F.col("p").alias("src_ai_prob"))
    t = tgt.select(pair, "j", F.col("sentence").alias("tgt_human"), F.col("p").alias("tgt_ai_prob"))
    return best.join(s, [pair, "i"]).join(t, [pair, "j"])


def best_match_pairs(src: DataFrame, tgt: DataFrame, pair: str = "pair_id", min_sim: float = 0.18,
                     min_score: float = 0.5, min_drop: float = 0.03) -> DataFrame:
    """Each source sentence with its most similar target (earliest on ties), then the length, header and drop gates.

    ``src(pair, i, sentence, p)`` and ``tgt(pair, j, sentence, p)``. One row per source text: the first by (pair, i).
    What the source sentence alone decides is asked before the alignment.
    """
    src = written(src.filter((F.col("p") >= min_score) & ~has_page_header("sentence")), "sources")
    tgt = written(tgt, "targets")
    rows = _pair_rows(aligned(src, tgt, min_sim, pair, pick="best"), src, tgt, pair)
    rows = rows.filter(
        length_ratio_ok("src_ai", "tgt_human")
        & ~has_page_header("tgt_human")
        & (F.col("tgt_ai_prob") < F.col("src_ai_prob") - min_drop)
        & (F.col("src_ai") != F.col("tgt_human"))
    )
    first = F.min(F.struct(pair, "i", "j", "tgt_human", "src_ai_prob", "tgt_ai_prob", "sim")).alias("r")
    return rows.groupBy("src_ai").agg(first).select("src_ai", "r.*")


def first_match_pairs(src: DataFrame, tgt: DataFrame, pair: str = "pair_id", min_sim: float = 0.3,
                      min_score: float = 0.5, min_drop: float = 0.03, first: int | None = None) -> DataFrame:
    """Each high source sentence with the first target, in order, that is similar, clearly lower and of like length.

    ``first`` limits both sides to their first sentences; by default whole documents are aligned. One row per source text.
    """
    if first is not None:
        src, tgt = src.filter(F.col("i") < first), tgt.filter(F.col("j") < first)
    src, tgt = written(src.filter(F.col("p") >= min_score), "sources"), written(tgt, "targets")
    best = _pair_rows(aligned(src, tgt, min_sim, pair, pick="first", min_drop=min_drop, max_gap=LENGTH_GAP), src, tgt, pair)
    once = F.min(F.struct(pair, "i", "j", "tgt_human", "src_ai_prob", "tgt_ai_prob", "sim")).alias("r")
    return best.groupBy("src_ai").agg(once).select("src_ai", "r.*")


# --- containment -------------------------------------------------------------------------------------------------

KEY_LENGTH = 20
BLOCK_KEY_LENGTH = 24


def containing_documents(keys: DataFrame, docs: DataFrame, key_id: str, key: str, doc: str = "doc_id",
                         clean: str = "clean") -> DataFrame:
    """First document (by id) whose cleaned text contains each 20-character key: ``key_id, doc``.

    The documents' overlapping 20-character pieces meet the keys in an equi-join on their hash; a small key table is
    broadcast by the optimiser, so pieces without a key never leave their task. Equal pieces count once per document.
    """
    k = keys.select(key_id, key, F.xxhash64(key).alias("_h"))
    grams = F.regexp_extract_all(F.col(clean), F.lit(f"(?s)(?=(.{{{KEY_LENGTH}}}))"), F.lit(1))
    hashed = docs.select(F.col(doc), F.explode(F.array_distinct(grams)).alias("_g")).withColumn("_h", F.xxhash64("_g"))
    hits = hashed.join(k, "_h").filter(F.col("_g") == F.col(key))
    return hits.groupBy(key_id).agg(F.min(doc).alias(doc))


def paragraph_contexts(pairs: DataFrame, docs: DataFrame, pair_id: str = "pair_id", doc: str = "doc_id",
                       text: str = "text", min_han: int = 20) -> DataFrame:
    """The block around each source sentence, and the same block with the target in its place.

    ``pairs(pair_id, src_ai, tgt_human)``. Blocks end at 。！？； and line breaks; the context runs from one block before
    to two behind. A source text is used once (its lowest pair id).
    """
    p = pairs.select(pair_id, strip_space("src_ai").alias("src"), strip_space("tgt_human").alias("tgt"))
    p = p.filter((F.col("src") != "") & (F.col("tgt") != "")).withColumn("_c", drop_space("src")).filter(F.length("_c") >= 10)
    p = p.withColumn("_key", F.substring("_c", 1, KEY_LENGTH)).withColumn("_bkey", F.substring("_c", 1, BLOCK_KEY_LENGTH))
    clean = docs.select(doc, drop_space(text).alias("clean"))
    found = containing_documents(p.filter(F.length("_key") == KEY_LENGTH), clean, pair_id, "_key", doc)
    short = p.filter(F.length("_key") < KEY_LENGTH)
    found = found.unionByName(_short_key_documents(short, clean, pair_id, doc))
    rows = p.join(found, pair_id).join(docs.select(doc, text), doc)
    blocks = F.split(text, "(?<=[。！？；\\n])")
    at = F.array_position(F.transform("_blocks", lambda b: F.contains(drop_space(b), F.col("_bkey"))), F.lit(True)).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_at", at).filter(F.col("_at") > 0)
    own = F.get("_blocks", F.col("_at") - 1)
    before = F.array_join(F.slice("_blocks", F.greatest(F.col("_at") - 1, F.lit(1)), F.least(F.col("_at") - 1, F.lit(1))), "")
    after = F.array_join(F.slice("_blocks", F.col("_at") + 1, F.lit(2)), "")
    swapped = F.replace(own, F.col("src"), F.col("tgt"))
    out = rows.select(
        pair_id, doc, F.concat(before, own, after).alias("src_para"), F.concat(before, swapped, after).alias("tgt_para"),
        F.col("src").alias("src_sentence"), F.col("tgt").alias("tgt_sentence"),
    )
    out = out.filter(F.length(F.regexp_replace("src_para", r"[^\x{4e00}-\x{9fff}]+", "")) >= min_han)
    cols = [c for c in out.columns if c != "src_sentence"]
    return out.groupBy("src_sentence").agg(F.min(F.struct(*cols)).alias("r")).select("src_sentence", "r.*")


def _short_key_documents(keys: DataFrame, clean: DataFrame, pair_id: str, doc: str) -> DataFrame:
    """Keys of 10 to 19 characters, matched on pieces of their own length."""
    lengths = list(range(10, KEY_LENGTH))
    pieces = F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all(F.col("clean"), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths
    ])))
    needed = keys.select(pair_id, F.col("_c").alias("_key"), F.xxhash64("_c").alias("_h"))
    hashed = clean.select(doc, F.explode(pieces).alias("_g")).withColumn("_h", F.xxhash64("_g"))
    hits = hashed.join(needed, "_h").filter(F.col("_g") == F.col("_key"))
    return hits.groupBy(pair_id).agg(F.min(doc).alias(doc))


# --- score joins, filters, statistics ----------------------------------------------------------------------------

def attach_pair_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds ``s_src`` and ``s_tgt`` from ``scores(text_hash, score)``, joined on the md5 of the two texts."""
    s = scores.select("text_hash", "score").groupBy("text_hash").agg(F.min("score").alias("score"))
    src = s.select(F.col("text_hash").alias("_hs"), F.col("score").alias("s_src"))
    tgt = s.select(F.col("text_hash").alias("_ht"), F.col("score").alias("s_tgt"))
    rows = pairs.withColumn("_hs", F.md5("src_ai")).withColumn("_ht", F.md5("tgt_human"))
    return rows.join(src, "_hs", "left").join(tgt, "_ht", "left").drop("_hs", "_ht")


def pair_reason(src: str = "src_ai", tgt: str = "tgt_human", s_src: str = "s_src", s_tgt: str = "s_tgt",
                sim: Column | str = "sim_ref", min_sim: float = 0.6) -> Column:
    """First reason to drop a pair (empty, unscored, heading, no_drop, low_sim) or ``kept``."""
    sim = F.col(sim) if isinstance(sim, str) else sim
    return (
        F.when((strip_space(F.coalesce(F.col(src), F.lit(""))) == "") | (strip_space(F.coalesce(F.col(tgt), F.lit(""))) == ""), "empty")
        .when(is_heading(src) | is_heading(tgt), "heading")
        .when(F.col(s_src).isNull() | F.col(s_tgt).isNull(), "unscored")
        .when(~(F.col(s_src) > F.col(s_tgt)), "no_drop")
        .when(F.coalesce(sim, F.lit(0.0)) < min_sim, "low_sim")
        .otherwise("kept")
    )


def faithful_pairs(pairs: DataFrame, src_vec: str = "src_vec", tgt_vec: str = "tgt_vec") -> tuple[DataFrame, DataFrame]:
    """``(kept, reasons)``: pairs that keep their meaning and lose score, and how many fell to each test."""
    rows = pairs.withColumn("sim_ref", cosine(src_vec, tgt_vec)).withColumn("reason", pair_reason())
    kept = rows.filter(F.col("reason") == "kept").withColumn("sim_ref", F.round("sim_ref", 3)).withColumn(
        "delta", F.round(F.col("s_src") - F.col("s_tgt"), 3)
    )
    return kept.drop("reason"), rows.groupBy("reason").agg(F.count("*").alias("n"))


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with neither side contaminated."""
    return pairs.filter(~is_contaminated("src_ai") & ~is_contaminated("tgt_human"))


def contaminated_count(pairs: DataFrame) -> DataFrame:
    dropped = is_contaminated("src_ai") | is_contaminated("tgt_human")
    return pairs.agg(F.count("*").alias("n"), F.count_if(dropped).alias("dropped"))


def merge_origins(pools: dict[str, DataFrame]) -> DataFrame:
    """Union of pair pools; a pair without ``src`` gets its pool's tag."""
    out = None
    for tag, df in pools.items():
        have = F.coalesce(F.col("src"), F.lit(tag)) if "src" in df.columns else F.lit(tag)
        df = df.withColumn("src", have)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def dedup_pairs(pairs: DataFrame, position: str) -> DataFrame:
    """One pair per source sentence: the best origin, then the earliest position. Copies reduce before the shuffle."""
    rank = F.lit(3)
    for tag, r in ORIGIN_ORDER.items():
        rank = F.when(F.col("src") == tag, r).otherwise(rank)
    cols = [c for c in pairs.columns if c != "src_ai"]
    pick = F.min_by(F.struct(*cols), F.struct(rank.alias("r"), F.col(position).alias("p")))
    return pairs.groupBy("src_ai").agg(pick.alias("r")).select("src_ai", "r.*")


def pair_statistics(pairs: DataFrame, by: str = "src") -> DataFrame:
    return pairs.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("src_ai_prob").alias("mean_src"), F.avg("tgt_ai_prob").alias("mean_tgt"),
        F.avg(F.col("src_ai_prob") - F.col("tgt_ai_prob")).alias("mean_drop"),
    )


def before_after(before: DataFrame, after: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Document reports of two versions side by side: overall score, AI sentences, difference."""
    b = before.select(pair, F.col("overall_ai_prob").alias("before"), F.col("ai_sentence_count").alias("ai_before"))
    a = after.select(pair, F.col("overall_ai_prob").alias("after"), F.col("ai_sentence_count").alias("ai_after"))
    return b.join(a, pair).withColumn("delta", F.round(F.col("before") - F.col("after"), 4))


def rewrite_outcomes(pairs: DataFrame, sim: str = "sim", delta: str = "delta") -> DataFrame:
    """Counts of faithful (similar and lower) and gaming (dissimilar and lower) rewrites, one row."""
    lower = F.col(delta) > 0.15
    return pairs.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(delta) > 0).alias("n_lower"),
        F.avg(delta).alias("mean_delta"),
        F.avg(sim).alias("mean_sim"),
        F.count_if((F.col(sim) >= 0.6) & lower).alias("faithful"),
        F.count_if((F.col(sim) < 0.4) & lower).alias("gaming"),
    )
