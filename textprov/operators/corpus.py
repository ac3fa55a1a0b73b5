"""Building corpora: deduplication, anti-joins, sampling, balancing, label guarding, self-training selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions.scores import prob_is_ai
from ..functions.text import han_count
from .scale import first_k, hash_cuts, ordered_hash, order_key, top_n_per_group, unit_hash

# --- sets --------------------------------------------------------------------------------------------------------


def dedup_first(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """One row per text, the first by ``order``. Copies collapse inside each task before anything is shuffled."""
    rest = [c for c in df.columns if c != text]
    pick = F.min_by(F.struct(*rest), F.struct(*order)) if len(order) > 1 else F.min_by(F.struct(*rest), F.col(order[0]))
    return df.groupBy(text).agg(pick.alias("_r")).select(text, "_r.*").select(*df.columns)


def unused_texts(pool: DataFrame, used: DataFrame, text: str = "text") -> DataFrame:
    """Rows of the pool whose exact text is not in use."""
    return pool.join(used.select(text).distinct(), text, "left_anti")


def new_annotations(batch: DataFrame, existing: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Rows of a batch whose md5 is new, once each; ``existing`` needs the column ``text_hash``."""
    fresh = dedup_first(batch, order, text).withColumn("text_hash", F.md5(text))
    return fresh.join(existing.select("text_hash"), "text_hash", "left_anti")


def labelled_union(ai: DataFrame, human: DataFrame, columns: list[str]) -> DataFrame:
    """AI and human pools in one table with ``label`` 1 and 0."""
    return ai.select(*columns, F.lit(1).alias("label")).unionByName(human.select(*columns, F.lit(0).alias("label")))


# --- sampling ----------------------------------------------------------------------------------------------------

def sample_n(df: DataFrame, ids, n: int, seed: int = 0) -> DataFrame:
    """The first n rows in hash order: the same rows whatever the partitioning."""
    return first_k(df, ids, n, seed)


def _capped(df: DataFrame, group: str, ids, cap: Column, seed: int) -> DataFrame:
    rows = df.withColumn("_h", order_key(ids, seed)).withColumn("_cap", cap).filter(F.col("_cap") > 0)
    salt = [ids] if isinstance(ids, str) else list(ids)
    return top_n_per_group(rows, group, [F.col("_h")], F.col("_cap"), salt_by=salt, rank="_rank").drop("_cap")


def stratified_cap(df: DataFrame, group: str, ids, cap: Column, target: DataFrame | int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per group in hash order, groups taken in name order until ``target`` rows are reached.

    ``cap`` is an expression over the group column (0 leaves a group out); ``target`` a number or a one-row ``k``.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_take", F.least(F.col("_n"), cap))
    run = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row per group
    limit = target.select("k").scalar() if isinstance(target, DataFrame) else F.lit(int(target))
    room = F.greatest(limit - F.coalesce(F.sum("_take").over(run), F.lit(0)), F.lit(0))
    sizes = sizes.withColumn("_take", F.least(F.col("_take"), room)).select(group, "_take")
    rows = _capped(df, group, ids, cap, seed).join(sizes, group)
    return rows.filter(F.col("_rank") <= F.col("_take")).drop("_h", "_rank", "_take")


def cap_per_group(df: DataFrame, group: str, ids, cap: Column, total: int | None = None, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per group in hash order, then at most ``total`` of them in hash order."""
    out = _capped(df, group, ids, cap, seed).drop("_h", "_rank")
    return out if total is None else first_k(out, ids, total, seed)


def zh_source_cap(source: str = "source") -> Column:
    """Rows taken per source for Chinese training; English sources are left out. Fixed values."""
    s = F.col(source)
    return (
        F.when(s == "C-ReD-paper", 1600).when(s == "HC3", 900).when(s.startswith("M4-zh-qa"), 900)
        .when((s == "M4-en-academic") | s.startswith("M4-en-wiki"), 0).otherwise(300)
    )


def en_source_cap(source: str = "source") -> Column:
    """Rows taken per source for English training. Fixed values."""
    return F.when(F.col(source).contains("academic"), 1500).otherwise(800)


def generator_cap(generator: str = "generator") -> Column:
    """Rows taken per generator in the hold-out experiment. Fixed values."""
    return F.when(F.col(generator) == "chatgpt", 200).otherwise(900)


def increment_target(base_ai: DataFrame, human: DataFrame, ratio: float = V.RATIO_HUMAN_TO_AI) -> DataFrame:
    """How many public AI rows to add, one row ``k``: min(9000, max(floor(human / ratio) - base, 1000))."""
    n_ai = base_ai.agg(F.count("*").alias("n_ai"))
    room = F.floor(F.col("n_human") / ratio) - F.col("n_ai")
    return human.agg(F.count("*").alias("n_human")).withColumn("n_ai", n_ai.scalar()).select(
        F.least(F.lit(9000), F.greatest(room, F.lit(1000))).cast("bigint").alias("k")
    )


def balance(ai: DataFrame, human: DataFrame, ids, ratio: float = V.RATIO_HUMAN_TO_AI, priority: Column | None = None,
            seed: int = 0) -> DataFrame:
    """Human rows cut to ``floor(n_ai * ratio)``: priority rows first, hash order inside a priority."""
    k = ai.agg(F.floor(F.count("*") * F.lit(ratio)).alias("k"))
    return first_k(human, ids, k, seed, priority=priority)


def split_by_hash(df: DataFrame, ids, share: float, seed: int = 0) -> DataFrame:
    """Adds ``split``: 'a' for about ``share`` of the rows, 'b' for the rest; a row's side depends on its identity only."""
    return df.withColumn("split", F.when(unit_hash(ids, seed) < share, "a").otherwise("b"))


def stratified_holdout(df: DataFrame, label: str, ids, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``is_test``: exactly ``round(n * share)`` rows of every class, in hash order."""
    keyed = df.withColumn("_h", ordered_hash(ids, seed))
    cuts = hash_cuts(keyed, F.round(F.col("_all") * share).cast("bigint"), label)
    test = F.lit(False)
    for r in cuts.filter(F.col(label).isNotNull()).collect():  # one row a class
        test = F.when(F.col(label) == F.lit(r[label]), F.col("_h") <= r["_cut"]).otherwise(test)
    return keyed.withColumn("is_test", test).drop("_h")


def holdout_groups(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """The groups held out as a whole: the first ``max(1, floor(n * share))`` group names in hash order."""
    names = df.filter(F.col(group).isNotNull()).select(group).distinct()
    k = names.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).cast("bigint").alias("k"))
    return first_k(names, group, k, seed)


def split_groups(df: DataFrame, group: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(test, train)``; rows without a group are in neither."""
    return df.join(held, group, "left_semi"), df.filter(F.col(group).isNotNull()).join(held, group, "left_anti")


def leave_one_out(df: DataFrame, generator: str = "generator", label: str = "label") -> DataFrame:
    """Per held-out generator: AI rows and human rows of its test set, AI rows left for training.

    Counted from one aggregate over generators; the rows of a hold-out are ``generator = held`` and all human rows.
    """
    per = df.groupBy(generator).agg(
        F.count_if(F.col(label) == 1).alias("n_ai"), F.count_if(F.col(label) == 0).alias("n_human")
    )
    ai, human = per.agg(F.sum("n_ai")).scalar(), per.agg(F.sum("n_human")).scalar()
    return per.filter(F.col("n_ai") > 0).select(
        F.col(generator).alias("held_out"), F.col("n_ai").alias("test_ai"), human.alias("test_human"),
        (ai - F.col("n_ai")).alias("train_ai"),
    )


MIX_SHARES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]  # fixed values


def mixtures(pairs: DataFrame, ids: list[str], ai: str = "ai_text", human: str = "human_text",
             ai_chars: int = 800, human_chars: int = 8000) -> DataFrame:
    """Documents mixed from an AI text's head and a human text's head, one per share of the fixed list."""
    f = F.col("share")
    text = F.concat(
        F.substring(F.col(ai), F.lit(1), (f * ai_chars).cast("int")),
        F.substring(F.col(human), F.lit(1), ((F.lit(1.0) - f) * human_chars).cast("int")),
    )
    return pairs.withColumn("share", F.explode(F.array(*[F.lit(s) for s in MIX_SHARES]))).select(*ids, "share", text.alias("text"))


def length_variants(docs: DataFrame, ids: list[str], text: str = "text", lengths=(300, 8000)) -> DataFrame:
    """Heads of each document at fixed lengths, for the length-sensitivity check."""
    heads = F.array(*[F.struct(F.lit(n).alias("head"), F.substring(text, 1, n).alias("text")) for n in lengths])
    return docs.select(*ids, F.inline(heads))


def concat_first(df: DataFrame, group: str, position: str, k: int, text: str = "text", sep: str = "") -> DataFrame:
    """The first k texts of each group joined in order; k is small, so a group's list is bounded."""
    top = top_n_per_group(df.select(group, position, text), group, [F.col(position)], k, salt_by=[position])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("i"), F.col(text).alias("t"))))
    return top.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias("text"))


# --- labels ------------------------------------------------------------------------------------------------------

def guard_labels(rows: DataFrame, scores: DataFrame, keep: float = 0.7, ai: float = 0.9, text: str = "text",
                 min_han: int = 10, eligible: Column | None = None) -> DataFrame:
    """Correct human labels by a deep score: AI at ``ai`` and above, dropped from ``keep``, else kept and tagged.

    A relabelled row gets the AI probability too. ``scores(text_hash, deep_prob)`` holds one row per text. ``eligible``
    replaces the test for enough Han characters.
    """
    test = (F.col("label") == "human") & ((han_count(text) >= min_han) if eligible is None else eligible)
    s = scores.select("text_hash", F.col("deep_prob").alias("_p"))
    out = rows.withColumn("text_hash", F.md5(text)).join(s, "text_hash", "left").withColumn("_hit", test & F.col("_p").isNotNull())
    p = F.col("_p")
    guard = F.when(~F.col("_hit"), None).when(p >= ai, "relabeled_ai").when(p >= keep, "dropped").otherwise("kept_human")
    out = out.withColumn("guard", guard).filter(F.coalesce(F.col("guard"), F.lit("")) != "dropped")
    relabelled = F.coalesce(F.col("guard"), F.lit("")) == "relabeled_ai"
    return (
        out.withColumn("label", F.when(relabelled, "AI").otherwise(F.col("label")))
        .withColumn("prob", F.when(relabelled, F.lit(V.PROB_AI)).otherwise(F.col("prob")))
        .withColumn("deep_prob", F.when(F.col("_hit"), F.round(p, 3)))
        .drop("_p", "_hit", "text_hash")
    )


def guard_pool(pool: DataFrame, threshold: float = 0.5, trusted: str = "C-ReD-paper", source: str = "source",
               score: str = "p") -> DataFrame:
    """Adds ``keep``: trusted sources stay, others only below the threshold."""
    return pool.withColumn("keep", (F.col(source) == trusted) | (F.col(score) < threshold))


def retention(pool: DataFrame, source: str = "source") -> DataFrame:
    return pool.groupBy(source).agg(F.count("*").alias("before"), F.count_if("keep").alias("after"))


def self_training(pool: DataFrame, used: DataFrame, ids, text: str = "text", score: str = "p", limit: float = 0.10,
                  max_rows: int = 20000, min_size: Column | None = None, seed: int = 2) -> DataFrame:
    """Confident human rows not in use yet: score at most ``limit``; labelled human with the human probability."""
    enough = (han_count(text) >= 20) if min_size is None else min_size
    rows = unused_texts(pool.filter(enough), used, text).filter(F.col(score) <= limit)
    return first_k(rows, ids, max_rows, seed).withColumn("prob", F.lit(V.PROB_HUMAN)).withColumn("label", F.lit("human"))


def false_positives(pool: DataFrame, used: DataFrame, text: str = "text", score: str = "p", limit: float = 0.40,
                    min_size: Column | None = None) -> DataFrame:
    """Unused human rows the model takes for AI; for diagnosis only."""
    enough = (han_count(text) >= 20) if min_size is None else min_size
    return unused_texts(pool.filter(enough), used, text).filter(F.col(score) >= limit)


def training_set(annotated: DataFrame, human: DataFrame, public_ai: DataFrame, public_human: DataFrame, ids: list[str],
                 cap: Column | None = None, ratio: float = V.RATIO_HUMAN_TO_AI, trusted: str = "C-ReD-paper",
                 seed: int = 2) -> DataFrame:
    """Training rows ``ids, text, label``.

    Annotated rows count as AI from probability 0.4 (missing: one half). Public AI rows are added up to the increment
    target, capped per source; public human rows fill up to the ratio, trusted source first; the human side is cut to
    the ratio in hash order.
    """
    cols = [*ids, "text"]
    is_ai = prob_is_ai("prob")
    base_ai = annotated.filter(is_ai == 1).select(*cols)
    local_human = human.select(*cols).unionByName(annotated.filter(is_ai == 0).select(*cols))
    target = increment_target(base_ai, local_human.unionByName(public_human.select(*cols)), ratio)
    extra = stratified_cap(public_ai.select(*cols, "source"), "source", ids, zh_source_cap() if cap is None else cap, target, seed)
    ai = base_ai.unionByName(extra.select(*cols))
    n_ai = ai.agg(F.floor(F.count("*") * F.lit(ratio)).alias("k"))
    need = n_ai.withColumn("k", F.greatest(F.col("k") - local_human.agg(F.count("*").alias("n")).scalar(), F.lit(0)))
    fill = first_k(public_human, ids, need, seed, priority=F.when(F.col("source") == trusted, 0).otherwise(1))
    chosen = first_k(local_human.unionByName(fill.select(*cols)), ids, n_ai, seed)
    return labelled_union(ai, chosen, cols)
