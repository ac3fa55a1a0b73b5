import random
import re

import numpy as np
import pytest

from textprov.operators.align import TargetIndex, aligned, candidates
from textprov.operators.pairs import best_match_pairs, first_match_pairs

WORDS = ["研究", "方法", "结果", "数据", "模型", "分析", "系统", "设计", "应用", "问题"]


def side(rnd, n, words=WORDS):
    return ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def tokens(s):
    return set(re.findall("[一-鿿]{2}", s))


def sim(a, b):
    x, y = tokens(a), tokens(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def frames(spark, a, b, rnd):
    src = [(f"p{k}", i, s, rnd.random()) for k, l in enumerate(a) for i, s in enumerate(l)]
    tgt = [(f"p{k}", j, s, rnd.random()) for k, l in enumerate(b) for j, s in enumerate(l)]
    return (src, tgt, spark.createDataFrame(src, "pair_id string, i long, sentence string, p double"), spark.createDataFrame(tgt, "pair_id string, j long, sentence string, p double"))


@pytest.mark.parametrize("block", [2048, 7])
def test_picks_equal_nested_loops(spark, block):
    """All pairs, the best and the first, with one block a document and with many; one document has no counterpart."""
    rnd = random.Random(9)
    src, tgt, s, t = frames(spark, [side(rnd, 25) for _ in range(3)] + [side(rnd, 4)], [side(rnd, 30) for _ in range(3)], rnd)
    for threshold in (.18, .5, 1.0):
        every = {(p, i, j): sim(x, y) for p, i, x, _ in src for q, j, y, _ in tgt if p == q and sim(x, y) >= threshold}
        assert {(r.pair_id, r.i, r.j): r.sim for r in aligned(s, t, threshold, block=block).collect()} == pytest.approx(every)
        best = {}
        for (p, i, j), v in sorted(every.items(), key=lambda x: (-x[1], x[0])):
            best.setdefault((p, i), (j, v))
        assert {(r.pair_id, r.i): (r.j, r.sim) for r in aligned(s, t, threshold, pick="best", block=block).collect()} == best
        ps, pt = {x[:2]: x for x in src}, {x[:2]: x for x in tgt}
        first = {}
        for (p, i, j), v in sorted(every.items()):
            x, y = ps[p, i], pt[p, j]
            if y[3] < x[3] - .03 and abs(len(y[2]) - len(x[2])) / max(1, len(x[2])) < .6:
                first.setdefault((p, i), (j, v))
        assert {(r.pair_id, r.i): (r.j, r.sim) for r in aligned(s, t, threshold, pick="first", min_drop=.03, max_gap=.6, block=block).collect()} == first


def test_bounds_leave_few_pairs_open():
    """Overlaps equal set operations, and far fewer pairs than all are counted to the end when only the best count."""
    rnd = np.random.default_rng(4)
    make = lambda n: [np.unique(rnd.zipf(1.3, 40) % 500) for _ in range(n)]
    a, b = make(200), make(300)
    b[17], b[250] = a[5], a[5]
    index = TargetIndex(np.array([len(x) for x in b]), np.concatenate(b))
    sizes, flat = np.array([len(x) for x in a]), np.concatenate(a)
    every = {(int(s), int(t)): int(c) for x in candidates(index, sizes, flat, .2, False) for s, t, c in zip(*x)}
    assert every == {(i, j): len(np.intersect1d(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if len(np.intersect1d(x, y)) >= .2 * len(np.union1d(x, y))}
    open_ = {(int(s), int(t)): int(c) for x in candidates(index, sizes, flat, .2, True) for s, t, c in zip(*x)}
    share = lambda i, j, c: c / (len(a[i]) + len(b[j]) - c)
    for i in range(200):
        mine = {j: share(i, j, c) for (k, j), c in every.items() if k == i}
        if mine:
            top = max(mine.values())
            assert {j for j, v in mine.items() if v == top} <= {j for k, j in open_ if k == i}
    assert open_.items() <= every.items() and len(open_) < len(every)
    assert {j for k, j in open_ if k == 5} == {17, 250} and sum(k == 5 for k, _ in every) > 50


def test_gates_of_the_source_come_first(spark):
    src = spark.createDataFrame([(1, 0, "研究方法结果数据模型", .9), (1, 1, "摘要研究方法结果数据", .9), (1, 2, "分析系统设计应用问题", .4), (1, 3, "", .9), (1, 4, None, .9)], "pair_id long, i long, sentence string, p double")
    tgt = spark.createDataFrame([(1, 0, "研究方法结果数据应用", .1), (1, 1, "分析系统设计应用问题", .1), (1, 2, "研究方法结果数据应用", .2), (1, 3, None, .1)], "pair_id long, j long, sentence string, p double")
    assert [(r.i, r.j) for r in best_match_pairs(src, tgt).collect()] == [(0, 0)]
    assert sorted((r.i, r.j) for r in first_match_pairs(src, tgt).collect()) == [(0, 0), (1, 0)]
    assert best_match_pairs(src.limit(0), tgt).count() == best_match_pairs(src, tgt.limit(0)).count() == 0
    with pytest.raises(ValueError):
        aligned(src, tgt, .2, pick="best", min_drop=.1)


def test_rows_between_the_stages(spark):
    """One row for each source sentence and block leaves the matching, and no table of tokens is shuffled."""
    rnd = random.Random(3)
    _, _, s, t = frames(spark, [side(rnd, 60)], [side(rnd, 60)], rnd)
    plan = aligned(s, t, .18, pick="best")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    assert aligned(s, t, .18, pick="best").count() <= 60 < aligned(s, t, .18).count()
