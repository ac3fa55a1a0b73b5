import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.operators import corpus as C
from textprov.operators import models as M
from textprov.operators import ngram_lm as LM
from textprov.operators import pairs as P
from textprov.operators import reports as REP
from textprov.plans.detect import detect, detect_batch
from textprov.sources import files as FI
from textprov.sources import records as REC
from textprov.streaming import ingest as ST


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"text": "a", "prob": .5}), "", "{bad", json.dumps([{"text": "b"}, {"text": "c", "label": "human"}]),
             json.dumps({"sentences": [{"text": "d"}]})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    assert sorted(r.text for r in REC.read_json_lines(spark, str(tmp_path / "x.jsonl")).collect()) == ["a", "b", "c", "d"]
    assert REC.read_json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_generator_csv(spark, tmp_path):
    text = "这是一个足够长的中文句子。第二句同样也是足够长的；分号也切开这个句子。"
    (tmp_path / "CReD_paper_gen-x.csv").write_text(f'text,label\n"{text}",0\n"{text}",1\n"{text}",oops\n', encoding="utf-8")
    rows = REC.read_generator_csv(spark, str(tmp_path)).collect()
    assert {r.generator for r in rows} == {"gen-x"} and len(rows) == 6 and sum(r.is_ai for r in rows) == 3


def test_paired_lists_and_cap(spark, tmp_path):
    words = "one two three four five six seven eight nine."
    recs = [{"human_text": [words, words], "machine_text": words}, {"human_text": words, "machine_text": None}]
    (tmp_path / "arxiv_gpt.jsonl").write_text("\n".join(map(json.dumps, recs)), encoding="utf-8")
    (tmp_path / "other_gpt.jsonl").write_text(json.dumps(recs[0]), encoding="utf-8")
    rows = REC.read_paired(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {r.source for r in rows} == {"M4-en-academic"} and {r.generator for r in rows} == {"gpt"}
    assert REC.read_paired(spark, str(tmp_path), cap=2).count() == 3


def test_discovery_and_sinks(spark, tmp_path):
    for p in ("in/PaperYY_1.html", "in/.git/PaperYY_2.html", "in/sub/AIGC报告.htm", "in/notes.html"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("<p>x</p>", encoding="utf-8")
    names = sorted(r.path.rsplit("/", 1)[1] for r in FI.discover_reports(spark, str(tmp_path / "in"), with_content=False).collect())
    assert names == ["AIGC报告.htm", "PaperYY_1.html"]
    df = spark.createDataFrame([("a", "zh", True), ("b", "en", False)], "text string, lang string, is_ai boolean")
    FI.write_samples(df, str(tmp_path / "out"))
    FI.write_samples(df, str(tmp_path / "out"), mode="append")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    FI.log_issues(FI.issue_records(df, "text"), str(tmp_path / "log"))
    assert {r.severity for r in spark.read.json(str(tmp_path / "log")).collect()} == {"med"}


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 2, "b")], "text string, pos int, tag string").repartition(3)
    assert sorted(tuple(r) for r in C.dedup_first(df, ["pos"]).collect()) == [("x", 1, "a"), ("y", 2, "b")]


def test_alignment_equals_nested_loops(spark):
    rng = random.Random(9)
    words = ["研究", "方法", "结果", "数据", "模型", "分析", "系统", "设计", "应用", "问题"]
    def side(n):
        return ["".join(rng.choice(words) for _ in range(rng.randint(3, 9))) for _ in range(n)]
    a, b = [side(25) for _ in range(3)], [side(25) for _ in range(3)]
    src = spark.createDataFrame([(p, i, s, .9) for p, l in enumerate(a) for i, s in enumerate(l)], "pair_id long, i long, sentence string, p double")
    tgt = spark.createDataFrame([(p, j, s, .1) for p, l in enumerate(b) for j, s in enumerate(l)], "pair_id long, j long, sentence string, p double")
    def sim(x, y):
        x, y = set(re.findall("[一-鿿]{2}", x)), set(re.findall("[一-鿿]{2}", y))
        return len(x & y) / len(x | y)
    for t in (.18, .3, .5, .8, 1.0):
        got = {(r.pair_id, r.i, r.j): r.sim for r in P.similar_sentences(src, tgt, t).collect()}
        expect = {(p, i, j): sim(x, y) for p in range(3) for i, x in enumerate(a[p]) for j, y in enumerate(b[p]) if sim(x, y) >= t}
        assert got == pytest.approx(expect)


def test_context_of_contained_sentence(spark):
    src, before = "这是需要改写的那个目标句子它足够长可以定位。", "前面的一个句子在这里。"
    doc = "无关紧要的开头句子。" + before + src + "后面第一个句子。后面第二个句子。结尾句子。"
    docs = spark.createDataFrame([(7, "别的文章。"), (8, doc), (9, doc)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, src, "改写之后。"), (2, "找不到的句子找不到的句子找不到。", "x")], "pair_id long, src_ai string, tgt_human string")
    r = P.paragraph_contexts(pairs, docs).collect()
    assert len(r) == 1 and r[0].doc_id == 8
    assert r[0].src_para == before + src + "后面第一个句子。后面第二个句子。"
    assert r[0].tgt_para == before + "改写之后。" + "后面第一个句子。后面第二个句子。"


def test_guard(spark):
    rows = spark.createDataFrame([(t, .1, lab) for t, lab in (("甲" * 12, "human"), ("乙" * 12, "human"), ("丙" * 12, "human"), ("丁", "human"), ("戊" * 12, "high"))],
                                 "text string, prob double, label string")
    scores = spark.createDataFrame([("甲" * 12, .95), ("乙" * 12, .8), ("丙" * 12, .2), ("丁", .99), ("戊" * 12, .99)], "t string, deep_prob double").select(
        F.md5("t").alias("text_hash"), "deep_prob")
    out = {r.text[0]: (r.label, r.guard) for r in C.guard_labels(rows, scores).collect()}
    assert out == {"甲": ("AI", "relabeled_ai"), "丙": ("human", "kept_human"), "丁": ("human", None), "戊": ("high", None)}


def test_language_model_by_hand(spark):
    texts = ["天地人天地人", "天地你", "天"]
    model = LM.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert tuple(model.stats.first()) == (5, 4)
    probe = spark.createDataFrame([(0, "天地人"), (1, "人天你"), (2, "你你你"), (3, "天")], "doc_id long, text string")
    got = {r.doc_id: r.prob for r in LM.gram_probabilities(model, probe, ["doc_id"]).collect()}
    assert got == pytest.approx({0: 3 / 8, 1: 1 / 6, 2: 1 / 10})
    assert {r.doc_id for r in LM.perplexity(model, probe, ["doc_id"]).collect()} == {0, 1, 2}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_language_model_equals_counts_in_python(spark, n):
    rng = random.Random(n)
    texts = ["".join(rng.choice("天地人山") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["天" * 500, None, ""]
    train, probe = [t or "" for t in texts[:20]], list(enumerate(texts))
    model = LM.train(spark.createDataFrame([(t,) for t in train], "text string"), n=n)
    grams = lambda t: [t[i:i + n] for i in range(len(t) - n + 1)]
    c, cn = Counter(g for t in train for g in grams(t)), Counter(g[:-1] for t in train for g in grams(t))
    vocab, total = len(set("".join(train))), sum(c.values())
    p = lambda g: (c[g] + 1) / (cn[g[:-1]] + vocab + 1) if cn[g[:-1]] else 1 / (total + vocab + 1)
    want = {i: math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t))) for i, t in probe if t and grams(t)}
    rows = spark.createDataFrame(probe, "doc_id long, text string")
    assert {r.doc_id: r.perplexity for r in LM.perplexity(model, rows, ["doc_id"]).collect()} == pytest.approx(want)
    counts = {(r.doc_id, r.n) for r in LM.gram_probabilities(model, rows, ["doc_id"]).filter("doc_id = 40").collect()}
    assert counts == {(40, 501 - n)}


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_probabilities_by_chunks(spark, monkeypatch, size):
    """A chunk asks for an n-gram once, whatever its texts; null ids, short, long and empty texts keep their rows."""
    monkeypatch.setattr(LM, "CHUNK_BYTES", size)
    rng = random.Random(9)
    texts = ["".join(rng.choice("天地人山a 1.") for _ in range(rng.choice([0, 2, 5, 40]))) for _ in range(30)] + ["天地人" * 300, None]
    rows = spark.createDataFrame([(None if i % 9 == 8 else i, str(i), t) for i, t in enumerate(texts)], "part long, name string, text string").coalesce(1)
    model = LM.train(rows.filter("part % 2 = 0"))
    words = lambda t: re.findall(r"[\u4e00-\u9fff]|[A-Za-z0-9]+|.", (t or "").replace(" ", ""))
    grams = {str(i): [tuple(w[k:k + 3]) for k in range(len(w) - 2)] for i, w in enumerate(map(words, texts))}
    trained = [g for i, gs in grams.items() if int(i) % 9 != 8 and int(i) % 2 == 0 for g in gs]
    c, cn, vocab = Counter(trained), Counter(g[:2] for g in trained), len({w for i in range(0, len(texts), 2) if i % 9 != 8 for w in words(texts[i])})
    p = lambda g: (c[g] + 1) / (cn[g[:2]] + vocab + 1) if cn[g[:2]] else 1 / (len(trained) + vocab + 1)
    found = LM.gram_probabilities(model, rows, ["part", "name"])
    got = sorted((r.name, r.n, round(r.prob, 9)) for r in found.collect())
    assert got == sorted((i, n, round(p(g), 9)) for i, gs in grams.items() for g, n in Counter(gs).items())
    assert found.filter("part is null").select("name").distinct().count() == sum(bool(grams[str(i)]) for i in range(8, len(texts), 9))


def test_reports(spark):
    text = "封面原文内容第一段话在这里。80%(8)第二段话也在。30%(7)"
    rows = REP.inline_segments(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).collect()
    assert [(r.sentence, r.prob, r.label) for r in rows] == [("第一段话在这里。", .8, "high"), ("第二段话也在。", .3, "human")]
    html = ('<p><em class="high x">高<b>度</b>疑似句</em> <div class="aigc-detection-chance-popover">AI生成的可能性为：<i class="n"> 87.5%</i></div>'
            '<em class="none">别的</em><em class="low">低疑似的句子</em>AI生成的可能性为：12%</p>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.text, r.pct) for r in REP.annotated_spans(pages, ["page_id"]).collect()] == [("高 度 疑似句", 87.5)]
    assert [r.pct for r in REP.annotated_spans(pages, ["page_id"], fallback=True).orderBy("span_idx").collect()] == [87.5, 12.0]
    runs = [(1, 0, i, t, *rgb) for i, (t, rgb) in enumerate([("高疑", (255, 0, 0)), ("似句子", (255, 0, 0)), ("空", (255, 255, 255)), ("人类写的句子", (0, 0, 0))])]
    merged = REP.merge_runs(spark.createDataFrame(runs, "doc_id long, para_idx int, run_idx int, text string, r int, g int, b int")).collect()
    assert sorted((r.text, r.label) for r in merged) == [("人类写的句子", "human"), ("高疑似句子", "high")]


def test_detection_edges(spark):
    docs = spark.createDataFrame([(1, ""), (2, "短。"), (3, "今天天气很好的。我们一起去公园吧！")], "doc_id long, text string")
    out = {r.doc_id: r for r in detect(docs).collect()}
    assert out[1].error and out[2].error and out[3].error is None and out[3].n_sentences == 2 and out[3].deep_prob is not None
    batch = detect_batch(paths=spark.createDataFrame([("p", None)], "path string, text string"), texts=docs.select("text")).collect()
    assert len(batch) == 4 and sum(r.error == "文件不存在" for r in batch) == 1


def test_classifier_learns_and_reloads(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, ("综上所述" if i % 2 else "其实呢") + "".join(rng.choice("天地人山水火风云") for _ in range(10)), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = M.fit_classifier(df, "id", max_iter=20, vectoriser=M.TextVectoriser(max_features=500, with_style=True))
    got = model.score(df).select("label", "p_stat").collect()
    assert sum((r.p_stat >= .5) == (r.label == 1) for r in got) / len(got) > .95
    model.save(str(tmp_path / "m"), spark)
    again = M.TextClassifier.load(str(tmp_path / "m"), spark).score(df).select("p_stat").collect()
    assert [round(r.p_stat, 9) for r in again] == [round(r.p_stat, 9) for r in got]


@pytest.mark.parametrize("style", [False, True])
def test_certificate_equals_gradient_in_numpy(spark, style):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("天地人山水火" if i % 3 else "天地风云雷") for _ in range(12)), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    x = M.TextVectoriser(max_features=60, with_style=style).fit(df).transform(df).cache()
    full = M.fit_logistic(x, max_iter=3000)
    data = x.select("features", "label").collect()
    a, y = np.array([r.features.toArray() for r in data]), np.array([r.label for r in data])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for model, done in ((full, True), (M.fit_logistic(x, max_iter=2), False)):
        r = w * (1 / (1 + np.exp(-(a @ model.coefficients.toArray() + model.intercept))) - y)
        want = max(abs(r.sum()), np.abs(a.T @ r + model.coefficients.toArray()).max()) / len(y)
        got = M.fit_certificate(x, model).first()
        assert (got.n, got.n_pos) == (90, 30) and got.gap == pytest.approx(want, abs=1e-9) and (got.gap < 1e-4) == done


def test_sigmoid_certificate(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(2 * (i % 2) - 1, 1.5), i % 2) for i in range(120)]
    held = spark.createDataFrame(rows, "m double, label int")
    slope, intercept = M.fit_sigmoid(held, "m")
    assert M.sigmoid_certificate(held, "m", slope, intercept).first().gap < 1e-4 < M.sigmoid_certificate(held, "m", slope + .1, intercept).first().gap
    n = p = 60
    y, m = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    r = 1 / (1 + np.exp(-(m * .5 + .25))) - np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    want = max(abs(r.mean()), abs((r * m).mean()) / np.abs(m).mean())
    assert M.sigmoid_certificate(held, "m", .5, .25).first().gap == pytest.approx(want)


def test_ngrams(spark):
    df = spark.createDataFrame([("aB  c",)], "t string")
    assert df.select(M.char_ngrams("t", 2, 3)).first()[0] == ["ab", "b ", " c", "ab ", "b c"]
    assert df.select(M.word_ngrams("t", 2, 4)).first()[0] == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]


def test_outside_scorer_keeps_order(spark):
    df = spark.createDataFrame([(i, "x" * (i * 37 % 300)) for i in range(200)], "i long, text string")
    out = M.score_texts(df, lambda: (lambda ts: [len(t) / 1000 for t in ts]), batch=16)
    assert all(r.p_deep == pytest.approx(len(r.text) / 1000) for r in out.collect())


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, target, log = tmp_path / "in", str(tmp_path / "ann"), str(tmp_path / "log")
    src.mkdir()
    def add(name, texts):
        (src / name).write_text("\n".join(json.dumps({"text": t, "prob": .9, "label": "high", "pos": i}) for i, t in enumerate(texts)), encoding="utf-8")
    def run(tag):
        s = spark.readStream.schema("text string, prob double, label string, pos long").json(str(src))
        ST.ingest_reports(s, lambda b: b, target, str(tmp_path / tag), ["pos"], log).awaitTermination()
    add("a.json", ["甲", "乙", "甲"])
    run("c1")
    add("b.json", ["乙", "丙"])
    run("c1")
    run("c2")  # a lost checkpoint replays everything
    assert sorted(r.text for r in spark.read.parquet(target).collect()) == sorted(["甲", "乙", "丙"])
    due = ST.retrain_due(spark.read.parquet(log), threshold=2).first()
    assert due.due


def test_stream_scoring_takes_newest_model(spark, tmp_path):
    from textprov.plans.detect import stand_in_scorer
    src = tmp_path / "docs"
    spark.createDataFrame([(1, "今天天气很好的。我们一起去公园吧！")], "doc_id long, text string").write.parquet(str(src))
    spark.createDataFrame([(1, "a"), (2, "b")], "version int, path string").write.parquet(str(tmp_path / "v"))
    seen = []
    s = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    ST.score_arrivals(s, str(tmp_path / "v"), lambda p: seen.append(p) or stand_in_scorer, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert seen == ["b"] and spark.read.parquet(str(tmp_path / "out")).first().model_version == 2


@pytest.mark.parametrize("analyser", ["char", "word"])
def test_vectors_equal_the_definition(spark, analyser):
    """Also for letters outside the basic plane, and for a text of more characters than a key of 64 bits has digits for."""
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 20000))) + "".join(map(chr, range(0x20000, 0x20000 + 42000)))
    texts = ["Ab  ab\nabc\U0001f600\U0001f601", "ab abc\U0001f600\U0001f601 x", "", None, " ", "a", "abab abab\0\0 abab\0\0", many, many[:500] + " ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    low, high = (2, 4) if analyser == "char" else (2, 5)
    def grams(t):
        t = (t or "").lower()
        parts = [re.sub(r"\s\s+", " ", t)] if analyser == "char" else [f" {w} " for w in re.split(r"\s+", t) if w]
        return [p[i:i + n] for p in parts for n in range(low, high + 1) for i in range(len(p) - n + 1)]
    counts = [Counter(grams(t)) for t in texts]
    tf, seen = sum(counts, Counter()), Counter(g for c in counts for g in c)
    vocabulary = sorted((g for g in tf if seen[g] > 1), key=lambda g: (-tf[g], g.encode()))[:1000]
    v = M.TextVectoriser(analyser, 1000).fit(df)
    assert v.vocabulary == vocabulary
    got = {r.id: r.features for r in v.transform(df).collect()}
    for i, c in enumerate(counts):
        want = {k: (1 + np.log(c[g])) * (1 + np.log((len(texts) + 1) / (seen[g] + 1))) for k, g in enumerate(vocabulary) if g in c}
        norm = sum(x * x for x in want.values()) ** .5
        assert dict(zip(got[i].indices.tolist(), got[i].values)) == pytest.approx({k: x / norm for k, x in want.items()})
        assert got[i].size == len(vocabulary) and sorted(got[i].indices) == got[i].indices.tolist()


def test_holdout_reads_its_rows_three_times(spark):
    """Twice for the cuts and once for the result, without a shuffle of the rows; a row is there once, also with no class."""
    seen = spark.sparkContext.accumulator(0)
    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 != 9, F.col("id") % 3).alias("label"))
    out = C.stratified_holdout(rows.mapInArrow(passed, "id long, label long"), "label", "id", 0.2, seed=3)
    got = out.collect()
    assert seen.value <= 3000 and len(got) == 1000
    for c in (0, 1, 2):
        own = sorted((hashlib.md5(f"{r.id}|3".encode()).hexdigest(), r.is_test) for r in got if r.label == c)
        k = round(len(own) * .2)
        assert [t for _, t in own] == [True] * k + [False] * (len(own) - k)
    assert not any(r.is_test for r in got if r.label is None)


def test_documents_are_scored_in_small_parts(spark):
    """The score is the number of texts that a scorer gets at once: not all sentences of a large Arrow batch."""
    df = spark.range(3000).coalesce(1).select("id", F.when(F.col("id") % 7 == 0, "en").otherwise("zh").alias("text_lang"),
                                              F.when(F.col("id") % 11 > 0, F.array(F.lit("甲"), F.lit("乙"))).alias("sents"))
    out = M.score_documents(df, lambda: (lambda ts: [float(len(ts))] * len(ts)), "p", skip_english=True, batch=10**9, max_len=None).collect()
    assert len(out) == 3000 and max(max(r.p) for r in out if r.p) <= 2 * M.DOCUMENTS_TOGETHER
    assert all((r.p is None) == (r.id % 7 == 0 or r.id % 11 == 0) for r in out)
