import random

import pytest
from pyspark.sql import functions as F

from textprov.operators import calibrate as CAL
from textprov.operators import evaluate as E


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(2)
    rows = [(p := round(rnd.random(), 3), int(rnd.random() < p)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "p double, label int")
    return df, CAL.fit_isotonic(df)


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_isotonic_join_equals_the_model(spark, fitted, buckets):
    """Every score, inside and outside the fitted range, whatever the number of buckets; one row in, one row out."""
    df, model = fitted
    xs, _ = CAL.isotonic_curve(model)
    probe = [*xs, *(random.Random(3).random() for _ in range(500)), -5.0, -0.001, 0.0, 1.0, 1.0001, 7.0, 7.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(probe)], "i int, p double").withColumn("x0", F.lit("own")).withColumn("slope", F.lit(1))
    mine = CAL.isotonic_scores(rows, model, buckets=buckets)
    assert mine.columns == ["i", "p", "x0", "slope", "p_iso"]
    model_p = {r.i: r.p_iso for r in model.transform(rows.withColumnRenamed("p", "f")).collect()}
    got = mine.collect()
    assert len(got) == len(probe) and all(r.p_iso == pytest.approx(model_p[r.i], abs=1e-12) for r in got)


def test_isotonic_join_of_odd_scores(spark, fitted):
    _, model = fitted
    _, ys = CAL.isotonic_curve(model)
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf"))], "i int, p double")
    assert {r.i: r.p_iso for r in CAL.isotonic_scores(rows, model).collect()} == {1: None, 2: ys[-1], 3: ys[-1], 4: ys[0]}
    assert CAL.isotonic_scores(rows.limit(0), model).count() == 0


def test_isotonic_map_of_one_knot(spark):
    model = CAL.fit_isotonic(spark.createDataFrame([(.5, 1), (.5, 0)], "p double, label int"))
    rows = spark.createDataFrame([(.2,), (.5,), (.9,)], "p double")
    assert [r.p_iso for r in CAL.isotonic_scores(rows, model).collect()] == [.5, .5, .5]


def test_isotonic_plan_has_no_literal_for_each_knot(spark, fitted):
    df, model = fitted
    short = CAL.isotonic_scores(df, model)
    text = short._jdf.queryExecution().optimizedPlan().toString()
    assert len(model.boundaries) > 20 and len(text) < 8000 and "0.0" in text


def test_sketches_merge(spark):
    """Unions of stored sketches count the union, not the sum, within their error; empty tables and nulls count nothing."""
    rows = [(f"s{i % 4}", f"w{(i * 7919) % 6000}") for i in range(24_000)] + [("s0", None)] * 5
    df = spark.createDataFrame(rows, "source string, word string")
    parts = E.distinct_sketches(df, "word", "source")
    one = E.merged_sketches(parts).first()
    assert abs(one["n_estimated"] - 6000) <= 4 * E.sketch_error() * 6000 and one["n"] == 24_000
    later = E.distinct_sketches(spark.createDataFrame([("s9", f"new{i}") for i in range(500)], "source string, word string"), "word", "source")
    both = E.merged_sketches(parts.unionByName(later)).first()
    assert abs(both["n_estimated"] - 6500) <= 4 * E.sketch_error() * 6500
    each = {r.source: r for r in E.merged_sketches(parts, "source").collect()}
    for s, r in each.items():
        exact = len({w for x, w in rows if x == s and w})
        assert abs(r.n_estimated - exact) <= 4 * E.sketch_error() * exact + 1
    assert E.distinct_sketches(df.limit(0), "word", "source").count() == 0
