"""VARIANT records, discovered files, runs and marks over chunks, outside scorers in batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textprov.operators import models as M
from textprov.operators import reports as REP
from textprov.sources import files as FI
from textprov.sources import records as REC


def test_json_lines_of_every_kind(spark):
    lines = ['{"text": "a", "prob": 0.5}', '[{"text": "b"}, 3, null, "x", [{"text": "no"}], {"text": "c", "prob": "0.25"}]', '{"sentences": [{"text": "d", "prob": true}, 1]}',
             '{"text": "e", "sentences": [{"text": "no"}]}', '{"prob": 1}', '{"text": 7, "label": null}', "", "  ", None, "null", "5", '"s"', '{"text": "f"', '{"text": "g"} {', '{"text": "g"}{"text": "h"}',
             '{"text": "g"}]', '1, {"text": "g"}', '{"text": "k", "text": "l"}', '  {"text": "m"}\t', '{"text": {"x": 1}}', "[]", "{}", '{"sentences": "none"}', '{"text": "n", "prob": "many"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "at int, value string")
    got = sorted((tuple(r) for r in REC.parse_json_lines(df, "text string, prob double", keep=["at"]).collect()), key=str)
    want = [(0, "a", .5), (1, "b", None), (1, "c", .25), (2, "d", 1.0), (3, "e", None), (4, None, 1.0), (5, "7", None), (18, "m", None), (19, '{"x":1}', None), (21, None, None), (22, None, None), (23, "n", None)]
    assert got == sorted(want, key=str)
    assert REC.parse_json_lines(df.limit(0)).count() == 0


def test_fields_that_are_text_or_lists(spark):
    lines = ['{"human_text": "one", "machine_text": ["two", 3, null, "four", ["five"]]}', '{"human_text": ["a\\nb"], "machine_text": null}', '{"human_text": "[\\"not a list\\"]"}', "[1]", "{"]
    rows = REC.paired_records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string"), keep=("i",))
    got = sorted(tuple(r) for r in rows.select("i", REC.variant_text("human_text"), REC.variant_text("machine_text")).collect())
    assert got == [(0, "one", "two\nfour"), (1, "a\nb", ""), (2, '["not a list"]', "")]


def test_written_files_are_discovered(spark, tmp_path):
    paths = ["PaperYY 1+2%.html", "a/b c/PaperYY_2.HTM", "a/.hidden/PaperYY_3.html", "node_modules/PaperYY_4.html", "x/site-packages/y/PaperYY_5.html", "a/notes.html", "PaperYY.txt", "a/AppData/PaperYY.pdf", "PaperYY_null.docx"]
    df = spark.createDataFrame([(p, f"content of {p} 好") for p in paths[:-1]] + [(paths[-1], None)], "path string, content string").repartition(3)
    for _ in range(2):  # a task that runs again writes the same files
        assert FI.write_files(df, f"file://{tmp_path}/reports") == len(paths)
    got = {r.path.split("/reports/")[1]: bytes(r.content).decode() for r in FI.discover_reports(spark, f"file://{tmp_path}/reports").collect()}
    assert got == {p: f"content of {p} 好" for p in paths[:2]}  # the reader passes empty files over
    assert FI.write_files(df.limit(0), f"file://{tmp_path}/none") == 0


COLOURS = {"high": (255, 0, 0), "human": (0, 0, 0), "skip": (255, 255, 255)}


def brute_runs(runs):
    out, grp, last = [], 0, None
    for _, text, label in sorted(r for r in runs if r[1]):
        if last is not None and label != last:
            grp += 1
        if label == last and out:
            out[-1][2] += text
        else:
            out.append([grp, label, text])
        last = label
    return sorted((g, x, t.strip()) for g, x, t in out if x != "skip" and len(t) > 4)


@pytest.mark.parametrize("chunk", [1, 3, 7, 64, 100_000])
def test_runs_over_chunk_borders(spark, chunk):
    """One long paragraph, others short, null keys, gaps between positions; whatever the chunks, the runs are the same."""
    rng, rows = random.Random(5), []
    for key, n in (("long", 400), ("short", 3), (None, 20), ("same", 90)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 1, 2, 30])
            label = "high" if key == "same" else rng.choice(["high", "high", "human", "skip"])
            rows.append((key, at, rng.choice(["", "天", "地人你好 ", "红色"]), label))
    df = spark.createDataFrame([(k, i, t, *COLOURS[x]) for k, i, t, x in rows], "k string, i int, text string, r int, g int, b int")
    got = REP.merge_runs(df, ["k"], "i", chunk=chunk).collect()
    for key in ("long", "short", None, "same"):
        want = brute_runs([(i, t, x) for k, i, t, x in rows if k == key])
        assert sorted((r.grp, r.label, r.text) for r in got if r.k == key) == want
    assert REP.merge_runs(df.limit(0), ["k"], "i").count() == 0


def test_marks_over_blocks(spark):
    """More marks than a block holds, with lengths of zero; the time of twice the marks is less than three times as long."""
    def report(n):
        body, want = [], []
        for i in range(n):
            piece = "" if i % 50 == 7 else f"第{i}段话写在这里。"
            body.append(f"{piece}{i % 100}%({len(piece)})")
            want += [(i, f"第{i}段话写在这里。", round(i % 100 / 100, 4))] if piece else []
        return "封面原文内容" + "".join(body), want

    for n in (0, 1, 127, 128, 129, 256, 700):
        text, want = report(n)
        rows = REP.inline_segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), ["doc_id"]).collect()
        assert sorted((r.seg_idx, r.sentence, r.prob) for r in rows) == want
    times = []
    for n in (8000, 16000):
        df = spark.createDataFrame([(1, report(n)[0])], "doc_id long, text string")
        start = time.time()
        assert REP.inline_segments(df, ["doc_id"]).count() == n - n // 50
        times.append(time.time() - start)
    print("marks:", times)
    assert times[1] < max(3 * times[0], 3)


def test_outside_scorers_in_batches(spark):
    seen = lambda: (lambda ts: [len(t) / 1000 for t in ts])
    docs = spark.createDataFrame([(i, "en" if i % 3 == 0 else "zh", None if i % 7 == 1 else ["x" * (i * k % 311) for k in range(i % 5)] + [None] * (i % 2)) for i in range(60)], "i long, text_lang string, sents array<string>")
    for r in M.score_documents(docs, seen, "p", skip_english=True, batch=8).collect():
        assert r.p == (None if r.sents is None or r.text_lang == "en" else [None if s is None else len(s) / 1000 for s in r.sents])
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else "x" * (i * 37 % 300)) for i in range(200)], "i long, text string").repartition(3)
    want = {r.i: None if r.text is None else len(r.text) / 1000 for r in rows.collect()}
    assert {r.i: r.p for r in rows.select("i", M.batch_scorer(seen, 16)("text").alias("p")).collect()} == want
    assert {r.i: r.p_deep for r in M.score_texts(rows, seen, batch=16, by_length=True).collect()} == want


def test_batches_hold_texts_of_similar_length():
    sizes = []
    M._in_batches(lambda ts: sizes.append([len(t) for t in ts]) or [0.0] * len(ts), ["x" * n for n in (5, 300, 1, 200, 9, 250)], 4, 200)
    assert sizes == [[1, 5], [9], [200], [250], [300]]  # halved for each text of more than 133 characters ahead
