"""Building blocks that keep every task bounded when one group holds a large share of the rows.

* ``dealt_out`` writes rows in parts of even size, whatever files they come from.
* ``top_n_per_group`` ranks inside salted parts of a group first, so no task sorts a whole hot group.
* ``with_group_stats`` brings group aggregates back to the rows through a join on (group, chunk of positions).
* ``sliding_rows`` cuts long sequences into chunks that overlap by one window width.
* ``first_k`` selects the first k rows of a hash order, k being any size, without a global sort.
* ``cumulative_counts`` gives running class counts along a score, through three bounded levels of prefixes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

CHUNK = 1 << 16


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def order_key(ids: str | Sequence[str], seed: int = 0) -> Column:
    """md5 of the row's identity and a seed: a reproducible shuffle order that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in _cols(ids)], F.lit(str(seed))))


def unit_hash(ids: str | Sequence[str], seed: int = 0) -> Column:
    """Reproducible uniform number in [0, 1) of a row's identity."""
    return F.conv(F.substring(order_key(ids, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def dealt_out(df: DataFrame) -> DataFrame:
    """``df`` written once, in as many parts as the session shuffles to, and no fewer than it has cores.

    A table of one large row group, and all that is made of it, is one task otherwise.
    """
    spark = df.sparkSession
    return cut_lineage(df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))


def top_n_per_group(df: DataFrame, keys, order: Sequence[Column], n: int | Column, salt_by, parts: int = 32,
                    rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group. ``salt_by`` names columns that spread a group's rows (its row identity).

    The first ranking runs per (group, salt) and leaves at most ``parts * n`` rows of a group to the second.
    """
    keys = _cols(keys)
    order = list(order)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in _cols(salt_by)]), F.lit(parts))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    out = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n).drop("_r", "_salt")
    rank_col = rank or "_r"
    out = out.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank_col) <= n)
    return out if rank else out.drop("_r")


def with_group_stats(df: DataFrame, group, position: str, aggs: Sequence[Column], chunk: int = CHUNK) -> DataFrame:
    """Rows with their group's aggregates, joined on (group, position chunk) so that a hot group is spread.

    ``position`` is a non-negative number that is dense within the group (a sentence index, a row number).
    """
    group = _cols(group)
    stats = df.groupBy(*group).agg(*aggs, F.max(F.col(position)).alias("_last"))
    stats = stats.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / chunk)))).drop("_last")
    rows = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    return rows.join(stats, [*group, "_chunk"], "left").drop("_chunk")


def sliding_rows(df: DataFrame, group, position: str, before: int, after: int, chunk: int = CHUNK):
    """``(rows, window, own)``: rows repeated where a neighbouring chunk needs them, the frame to use over them, and
    the predicate that keeps each row once after the window functions ran. Positions start at 0 and have no gaps."""
    group = _cols(group)
    own = F.floor(F.col(position) / chunk)
    first = F.floor(F.greatest(F.col(position) - after, F.lit(0)) / chunk)
    last = F.floor((F.col(position) + before) / chunk)
    rows = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy(*group, "_chunk").orderBy(position).rowsBetween(-before, after)
    return rows, frame, F.col("_chunk") == own


def ordered_hash(ids, seed: int, priority: Column | None = None) -> Column:
    prio = F.lit(0) if priority is None else priority.cast("int")
    return F.concat(F.lpad(prio.cast("string"), 4, "0"), order_key(ids, seed))


def hash_cuts(keyed: DataFrame, k: DataFrame | int | Column, group=()) -> DataFrame:
    """``_cut``, per group if one is given: the hash ``_h`` of the group's k-th row, above all hashes where there are fewer.

    ``k`` may also be a column over ``_all``, the group's number of rows. The rows are read twice, for the counts of the
    buckets and for the one bucket that holds the k-th row; the results are written.
    """
    group = _cols(group)
    slim = keyed.select(*group, "_h").withColumn("_b", F.substring("_h", 1, 8))
    counts = cut_lineage(slim.groupBy(*group, "_b").agg(F.count("*").alias("_n")))
    run = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    if isinstance(k, Column):
        counts = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*group))).withColumn("k", k).drop("_all")
    elif not isinstance(k, DataFrame):
        counts = counts.withColumn("k", F.lit(int(k)))
    elif group:
        counts = counts.join(k, group)
    else:
        counts = counts.withColumn("k", k.select("k").scalar())
    edge = counts.filter((F.col("_off") < F.col("k")) & (F.col("_off") + F.col("_n") >= F.col("k")))
    rn = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h")) + F.col("_off")
    cut = (
        slim.join(edge, [*group, "_b"])
        .withColumn("_rn", rn)
        .filter(F.col("_rn") == F.col("k"))
        .select(*group, F.col("_h").alias("_cut"))
    )
    # groups with fewer than k rows are taken whole
    whole = (
        counts.groupBy(*group)
        .agg(F.sum("_n").alias("_all"), F.max("k").alias("k"))
        .filter(F.col("_all") < F.col("k"))
        .select(*group, F.lit("~").alias("_cut"))
    )
    return cut_lineage(cut.unionByName(whole))


def first_k(df: DataFrame, ids, k: DataFrame | int, seed: int = 0, group=(), priority: Column | None = None) -> DataFrame:
    """Exactly the first k rows in (priority, hash) order, per group if one is given.

    ``k`` is a number or a DataFrame with column ``k`` (and the group columns). ``ids`` must identify a row. Rows are
    counted per hash bucket, the bucket holding the k-th row is ranked, and its hash becomes the cut for all rows;
    so only one bucket is ever sorted.
    """
    group = _cols(group)
    keyed = df.withColumn("_h", ordered_hash(ids, seed, priority))
    cuts = hash_cuts(keyed, k, group)
    if group:
        return keyed.join(cuts, group).filter(F.col("_h") <= F.col("_cut")).drop("_h", "_cut")
    return keyed.filter(F.col("_h") <= cuts.scalar()).drop("_h")


def ordered_key(score: Column) -> Column:
    """48-bit number that rises with a non-negative double: its binary exponent, then 37 bits of its mantissa.

    At most 2^15 different doubles share one key.
    """
    exponent = F.floor(F.log2(score)).cast("double")
    mantissa = score * F.pow(F.lit(2.0), -exponent) - 1
    return F.when(score < 1e-300, F.lit(0).cast("bigint")).otherwise(F.floor((exponent + 1075 + mantissa) * F.lit(float(1 << 37))))


def cumulative_counts(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """One row per distinct score (non-negative) with ``n_pos, n_neg`` and the counts strictly above it.

    Output columns: ``by, score, n_pos, n_neg, pos_above, neg_above``. Equal scores collapse before the first shuffle.
    Running sums are taken within 16-bit steps of a 48-bit order-preserving key, so every window partition holds
    65,536 rows at most, however the scores are distributed.
    """
    by = _cols(by)
    d = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"),
             F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n_neg"))
        .withColumn("_k3", ordered_key(F.col("score")))
    )
    d = cut_lineage(d)  # one small row per score; all levels below read it, not the texts
    sums = [F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")]
    c3 = d.groupBy(*by, "_k3").agg(*sums).withColumn("_k2", F.shiftright("_k3", 16))
    c2 = c3.groupBy(*by, "_k2").agg(*sums).withColumn("_k1", F.shiftright("_k2", 16))
    c1 = c2.groupBy(*by, "_k1").agg(*sums)

    def above(frame: DataFrame, part: list[str], order: str, tag: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(f"_p{tag}", F.coalesce(F.sum("n_pos").over(w), F.lit(0))).withColumn(
            f"_n{tag}", F.coalesce(F.sum("n_neg").over(w), F.lit(0))
        )

    a1 = above(c1, by, "_k1", "1").drop("n_pos", "n_neg")
    a2 = above(c2, [*by, "_k1"], "_k2", "2").drop("n_pos", "n_neg").join(a1, [*by, "_k1"]).drop("_k1")
    a3 = above(c3, [*by, "_k2"], "_k3", "3").drop("n_pos", "n_neg").join(a2, [*by, "_k2"]).drop("_k2")
    a4 = above(d, [*by, "_k3"], "score", "4").join(a3, [*by, "_k3"])
    return a4.select(
        *by, "score", "n_pos", "n_neg",
        (F.col("_p1") + F.col("_p2") + F.col("_p3") + F.col("_p4")).alias("pos_above"),
        (F.col("_n1") + F.col("_n2") + F.col("_n3") + F.col("_n4")).alias("neg_above"),
    )


def at_thresholds(df: DataFrame, score: str, label: str, thresholds: Sequence[float], by=()) -> DataFrame:
    """Counts at each threshold of a short fixed list: ``by, threshold, tp, fp, n_pos, n_neg``.

    Rows are counted once by the number of thresholds they reach; the list is applied to the counts, so the data is
    never multiplied by the number of thresholds.
    """
    by = _cols(by)
    ts = sorted(float(t) for t in thresholds)
    reached = F.lit(0)
    for t in ts:
        reached = reached + (F.col(score) >= F.lit(t)).cast("int")
    counts = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, reached.alias("_reached"))
        .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
             F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_neg"))
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(ts)])
    return (
        counts.withColumn("_s", F.explode(steps))
        .groupBy(*by, F.col("_s.t").alias("threshold"))
        .agg(
            F.sum(F.when(F.col("_reached") >= F.col("_s.i"), F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("_reached") >= F.col("_s.i"), F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum("_pos").alias("n_pos"),
            F.sum("_neg").alias("n_neg"),
        )
    )
