"""Line dedup: later copies of repeated runs of lines go, found by a suffix array over sequences of line ids.

A document is the sequence of its lines that have words. Line ids are ranks of line contents; distributed prefix
doubling refines them into ranks of suffixes by their first 1, 2, 4, ... lines. Only suffixes that share their rank with
another stay in the work: an interval of the array that has shrunk to one suffix is settled. A run of L lines from a
place is an interval of suffixes with a longest common prefix of L lines or more; it is named by two overlapping ranks.

A run counts if it has at least ``min_words`` words. The least run from each line onward, and the least run that ends
at each line, are looked up; a run whose interval holds an earlier place (by document id, text hash, line) is a later
copy. Together these cover every line of every maximal repeated run of ``min_words`` words or more, so that consecutive
marked lines are the maximal runs to delete. The first copy of every line stays.

Everything is DataFrame code: no group is gathered in one task except the lines of one document.

Defined cases: null and empty texts have no lines with words and stay as they are. Lines without words are never looked
at; they go only inside a deleted run. Rows of one id and one text are one document and are cut alike. Rows without an
id come first. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written

MIN_WORDS = 50
#: Rows that a window of the ranking holds on average at most, where values are spread evenly.
RANK_ROWS = 1 << 16

_PLACE = ["d", "h", "i"]


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, h (id and text hash of the document), i (place among its lines with words), n (line number), w (words), k1, k2
    (two hashes of the line)."""
    numbered = F.transform(F.split(F.col(text), "\n"), lambda x, n: F.struct(n.alias("n"), x.alias("line")))
    worded = F.filter(numbered, lambda s: s["line"].rlike(r"\S"))
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.posexplode(worded).alias("i", "s"))
    line = F.col("s.line")
    return rows.select("d", "h", "i", F.col("s.n").alias("n"), F.size(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")).alias("w"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"))


def _before(counts: DataFrame, group: list[str], bucket, order: list[str]) -> DataFrame:
    """``before``: the sum of ``c`` of all rows of the group that are smaller by ``order``; one window over buckets and
    one in each bucket, so that a large group is dealt out."""
    counts = counts.withColumn("bucket", bucket)
    totals = counts.groupBy(*group, "bucket").agg(F.sum("c").alias("total"))
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "bucket", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("lower"))
    inside = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return counts.join(totals, [*group, "bucket"]).withColumn("before", F.col("lower") + F.col("inner")).drop("bucket", "lower", "inner")


def line_ranks(lines: DataFrame, n: int) -> DataFrame:
    """d, h, i, rank (lines with a smaller id, by content order), c (lines of the same content)."""
    bits = max(1, min(20, (n // RANK_ROWS).bit_length()))
    counts = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"))
    ranked = _before(counts, [], F.shiftright("k1", 64 - bits), ["k1", "k2"])
    return lines.join(ranked.withColumnRenamed("before", "rank"), ["k1", "k2"]).select(*_PLACE, "rank", "c")


def _refined(active: DataFrame, ranks: DataFrame, k: int, n: int) -> DataFrame:
    """Ranks by the first 2k lines for suffixes that share their rank by the first k."""
    ahead = ranks.select("d", "h", (F.col("i") - k).alias("i"), F.col("rank").alias("next"))
    same = [F.col("a.d").eqNullSafe(F.col("b.d")), F.col("a.h") == F.col("b.h"), F.col("a.i") == F.col("b.i")]
    pairs = active.alias("a").join(ahead.alias("b"), same, "left").select("a.d", "a.h", "a.i", "rank", F.coalesce("next", F.lit(-1)).alias("next"))
    counts = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("c"))
    shift = max(0, n.bit_length() - max(1, (n // RANK_ROWS).bit_length()))
    moved = _before(counts, ["rank"], F.shiftright("next", shift), ["next"])
    return pairs.join(moved, ["rank", "next"]).select(*_PLACE, (F.col("rank") + F.col("before")).alias("rank"), "c")


def first_level(lines: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Suffixes that are settled by their first line, those that share it with others, and the number of lines."""
    n = lines.count()
    first = written(line_ranks(lines, n), "line-ranks").dropDuplicates(_PLACE)
    return first.filter("c = 1").select(*_PLACE, "rank"), written(first.filter("c > 1"), "line-level"), n


def suffix_levels(settled: DataFrame, active: DataFrame, n: int, depth: int) -> list[DataFrame]:
    """For k = 1, 2, 4, ... up to ``depth``: places, ranks by the first k lines, and how many suffixes share the rank;
    of suffixes that share it with others only. Settled ranks are kept for the order of the others."""
    levels, k = [active], 1
    while k * 2 <= depth and not active.isEmpty():
        new = written(_refined(active, settled.union(active.select(*_PLACE, "rank")), k, n), "line-level")
        settled, active, k = settled.union(new.filter("c = 1").select(*_PLACE, "rank")), new.filter("c > 1"), k * 2
        levels.append(active)
    return levels


def least_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """d, h, i, length: from each line on, and up to each line, the fewest lines with ``min_words`` words."""
    doc = Window.partitionBy("d", "h")
    lines = lines.select(*_PLACE, "w").dropDuplicates(_PLACE).withColumn("upto", F.sum("w").over(doc.orderBy("i"))).withColumn("since", F.col("upto") - F.col("w"))
    on = doc.orderBy("since").rangeBetween(0, min_words - 1)
    back = doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    lines = lines.withColumn("f", F.when(F.max("upto").over(on) - F.col("since") >= min_words, F.count(F.lit(1)).over(on)))
    lines = lines.withColumn("b", F.when(F.col("upto") - F.min("since").over(back) >= min_words, F.count(F.lit(1)).over(back)))
    runs = F.array_distinct(F.array(F.struct("i", F.col("f").alias("length")), F.struct((F.col("i") - F.col("b") + 1).cast("int").alias("i"), F.col("b").alias("length"))))
    return lines.select("d", "h", F.explode(runs).alias("r")).select("d", "h", "r.i", "r.length").filter("length is not null")


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """d, h, runs: per document with later copies, the first and last line numbers of its maximal runs to delete."""
    lines = written(document_lines(docs, doc_id, text), "lines")
    settled, shared, n = first_level(lines)
    runs = least_runs(lines, min_words).dropDuplicates(["d", "h", "i", "length"])
    runs = written(_at(runs, shared.select(*_PLACE), []), "least-runs")  # a run whose first line occurs once is no copy
    levels = suffix_levels(settled, shared, n, runs.agg(F.max("length")).first()[0] or 1)
    ranks = reduce(DataFrame.unionByName, [level.select(*_PLACE, F.lit(j).alias("j"), "rank") for j, level in enumerate(levels)])
    # the largest power of two within the run: its first and its last so many lines name it
    runs = runs.withColumn("j", F.length(F.bin("length")) - 1).filter(F.col("j") < len(levels))
    of = _at(runs, ranks.withColumnRenamed("rank", "r1"), ["r1"], ["j"])
    last = F.expr("cast(i + length - shiftleft(1, j) as int)")
    of = _at(of.withColumn("start", F.col("i")).withColumn("i", last), ranks.withColumnRenamed("rank", "r2"), ["r2"], ["j"])
    place = F.struct("d", "h", F.col("start").alias("i"))
    firsts = of.groupBy("length", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    copies = written(of.join(firsts, ["length", "r1", "r2"]).filter(place > F.col("first")).select("d", "h", "start", "length"), "later-copies")
    marked = copies.select("d", "h", F.explode(F.sequence("start", (F.col("start") + F.col("length") - 1).cast("int"))).alias("i")).distinct()
    marked = _at(marked, lines.select(*_PLACE, "n").dropDuplicates(_PLACE), ["n"])
    island = F.col("i") - F.row_number().over(Window.partitionBy("d", "h").orderBy("i"))
    islands = marked.withColumn("island", island).groupBy("d", "h", "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("lines"))
    return islands.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("lines").alias("removed"))


def _at(left: DataFrame, right: DataFrame, more: list[str], keys: list[str] = []) -> DataFrame:
    """Rows of ``left`` with the columns ``more`` of ``right`` at the same place (and equal ``keys``), or those that have
    a row there."""
    same = [F.col("l.d").eqNullSafe(F.col("r.d")), *(F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("h", "i", *keys))]
    if not more:
        return left.alias("l").join(right.alias("r"), same, "left_semi")
    return left.alias("l").join(right.alias("r"), same).select("l.*", *(f"r.{c}" for c in more))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` without later copies of runs; ``removed`` names an optional column with the count of deleted lines.

    A document that loses all its words stays as a row with what is left of its text.
    """
    names = free_names(docs, "cut_id", "cut_hash", "cut_runs", "cut_lines")
    cuts = later_copies(docs, doc_id, text, min_words).select("d", "h", "runs", "removed").toDF(*names)
    of, hashed, runs, lines = names
    joined = docs.join(cuts, F.col(doc_id).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(hashed)), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda x, n: ~F.exists(runs, lambda r: (r["first"] <= n) & (n <= r["last"])))
    kept = F.when(F.col(runs).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.coalesce(lines, F.lit(0)).alias(removed)] if removed else []))
