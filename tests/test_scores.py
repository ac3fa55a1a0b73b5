import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.functions import scores as SC
from textprov.functions import sequences as S
from textprov.operators import calibrate as CAL
from textprov.operators import evaluate as E
from textprov.operators import windows as WIN
from textprov.operators.scale import cumulative_counts, first_k, ordered_key, top_n_per_group


def test_fusion(spark):
    df = spark.createDataFrame([(.5, .5), (.2, .8), (.5, .75), (None, .7), (.3, None)], "a double, b double")
    assert [r[0] for r in df.select(SC.fuse("a", "b")).collect()] == pytest.approx([.5, .59, .625, .7, .3])


def docs(seed, n=60):
    rng = random.Random(seed)
    return [(d, [round(rng.random() ** 2, 3) if rng.random() < .8 else 0.0 for _ in range(rng.randint(1, 30))]) for d in range(n)]


def best_window(scores, width=6):
    w = min(width, len(scores))
    means = [sum(scores[i:i + w]) / w for i in range(len(scores) - w + 1)]
    top = max(round(m, 12) for m in means)
    return (top, next(i for i, m in enumerate(means) if round(m, 12) == top)) if top > 0 else (0.0, -1)


@pytest.mark.parametrize("chunk", [4, 7, 1 << 16])
def test_windows_in_rows_and_in_tables(spark, chunk):
    data = docs(1) + [(900, [0.0] * 8), (901, [.9, .9, .9])]
    expect = {d: best_window(s) for d, s in data}
    arr = spark.createDataFrame(data, "doc_id long, s array<double>")
    got = {r[0]: (r[1].best, r[1].start) for r in arr.select("doc_id", S.best_window(S.window_means(F.col("s")))).collect()}
    assert got == expect
    rows = arr.select("doc_id", F.posexplode("s").alias("sent_idx", "p"))
    table = {r.doc_id: (r.best, r.start) for r in WIN.densest_mean(rows, chunk=chunk).collect()}
    assert table == expect
    near = {(r.doc_id, r.sent_idx): r.neighborhood_mean for r in WIN.neighbourhoods(rows, chunk=chunk).collect()}
    assert len(near) == sum(len(s) for _, s in data)
    for d, s in data:
        for i in range(len(s)):
            part = s[max(0, i - 2):i + 3]
            assert near[(d, i)] == pytest.approx(sum(part) / len(part), abs=1e-4)


def test_gate(spark):
    arr = spark.createDataFrame([(1, [.1, .1, .7])], "doc_id long, s array<double>")
    out = arr.select(S.gate_array(F.col("s"))).first()[0]
    assert out == pytest.approx([.1, .1, .6074], abs=1e-4)


def test_calibration_stays_between_score_and_mean(spark):
    arr = spark.createDataFrame(docs(2), "doc_id long, s array<double>")
    rows = arr.select("doc_id", F.posexplode("s").alias("sent_idx", "p"))
    for fn in (CAL.context_calibrate, CAL.gate_calibrate):
        out = fn(rows).join(rows.groupBy("doc_id").agg(F.avg("p").alias("m")), "doc_id")
        lo, hi = F.least("p", "m"), F.greatest("p", "m")
        assert out.filter((F.col("p_cal") < lo - 1e-9) | (F.col("p_cal") > hi + 1e-9)).count() == 0


def test_reliability_bins(spark):
    df = spark.createDataFrame([(.2, 0), (.19, 0), (1.0, 1), (.6, 1)], "p double, label int")
    assert {r.bin_low: r.n for r in CAL.reliability(df).collect()} == {0.0: 1, .2: 1, .6: 1}
    assert {r.bin_low: r.n for r in CAL.reliability(df, closed_last=True).collect()}[.8] == 1


def test_isotonic_map_equals_model(spark):
    rng = random.Random(3)
    data = [(p, int(rng.random() < p)) for p in (round(rng.random(), 2) for _ in range(400))]
    df = spark.createDataFrame(data, "p double, label int")
    model = CAL.fit_isotonic(df)
    probe = spark.createDataFrame([(x / 50 - .2,) for x in range(70)], "p double").withColumn("f", F.col("p"))
    out = model.transform(probe).withColumn("mine", CAL.isotonic_map(model)(F.col("p"))).collect()
    assert all(r.mine == pytest.approx(r.p_iso, abs=1e-9) for r in out)


def pairs_auc(data):
    pos, neg = [p for p, y in data if y == 1], [p for p, y in data if y == 0]
    return sum((a > b) + .5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_and_best_f1_with_ties_and_tiny_scores(spark):
    rng = random.Random(4)
    data = [(rng.choice([rng.random(), round(rng.random(), 1), 1e-30 * rng.random(), 0.0, 1.0]), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(data, "p double, label int")
    assert E.rank_auc(df).first().auc == pytest.approx(pairs_auc(data), abs=1e-12)
    def f1(t):
        tp = sum(y for p, y in data if p >= t)
        return 2 * tp / (sum(p >= t for p, _ in data) + sum(y for _, y in data))
    best = E.best_f1_threshold(df).first()
    top = max(f1(p) for p, _ in data)
    assert best.f1 == pytest.approx(top, abs=1e-11)
    assert best.threshold == min(p for p, _ in data if abs(f1(p) - top) < 1e-12)
    c = cumulative_counts(df, "p", "label").collect()
    assert all(r.pos_above == sum(y for p, y in data if p > r.score) for r in c)
    assert E.rank_auc(df.filter("label = 1")).first().auc is None


def test_ordered_key_rises(spark):
    rng = random.Random(8)
    xs = sorted({rng.random() * 10 ** -rng.randint(0, 290) for _ in range(500)} | {2.0 ** -k for k in range(60)} | {np.nextafter(2.0 ** -k, 0) for k in range(1, 60)})
    keys = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1).select(ordered_key(F.col("x"))).collect()]
    assert keys == sorted(keys)


def test_sampling_is_exact_and_independent_of_partitions(spark):
    df = spark.range(0, 2000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")))
    for k in (0, 1, 137, 1999, 5000):
        a = {r.id for r in first_k(df.repartition(1), "id", k).collect()}
        b = {r.id for r in first_k(df.repartition(7), "id", k).collect()}
        assert a == b and len(a) == min(k, 2000)
    ks = df.groupBy("g").agg(F.lit(50).alias("k"))
    per = first_k(df, "id", ks, group=["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in per} == {50}
    top = top_n_per_group(df, "g", [F.col("id").desc()], 5, salt_by="id").filter("g = 'hot'").collect()
    assert sorted(r.id for r in top) == [1986, 1989, 1992, 1995, 1998]


def test_cost_sweep_counts(spark):
    data = [(i / 100, int(i > 50)) for i in range(100)]
    df = spark.createDataFrame(data, "p double, label int")
    rows = {r.threshold: r for r in E.cost_sweep(df).collect()}
    assert len(rows) == 40
    assert rows[.6].fn == sum(1 for p, y in data if y and p < .6) and rows[.4].fp == sum(1 for p, y in data if not y and p >= .4)
