import random
import re

import pytest
from pyspark.sql import functions as F

from textprov.functions import features as FE
from textprov.functions import report_fields as R
from textprov.functions import text as T


def values(spark, texts, *cols):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def scan_sentences(text, stops, dots, semis):
    """Sentence scanner written for the test: one character at a time."""
    out, start, quoted, i = [], 0, False, 0
    while i < len(text):
        c = text[i]
        quoted = True if c in "“「『" else False if c in "”」』" else quoted
        end = i + 1
        cut = False
        if c in stops and not quoted:
            while end < len(text) and text[end] in stops:
                end += 1
            cut = True
        elif c == "…" and not quoted and dots:
            while end < len(text) and text[end] == "…":
                end += 1
            cut = True
        elif c in semis:
            cut = True
        if cut:
            out.append(text[start:end])
            start = end
        i = end
    out.append(text[start:])
    return [s.strip() for s in out if len(s.strip()) > 4]


ALPHABET = "天地人。？！…“”「」；;，ab \n　"


@pytest.mark.parametrize("fn,dots,semis", [(T.zh_sentences, True, ""), (T.zh_corpus_sentences, False, ";；")])
def test_zh_splitters_equal_a_scanner(spark, fn, dots, semis):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    got = [r[0] for r in values(spark, texts, fn("t"))]
    assert got == [scan_sentences(t, "。？！", dots, semis) for t in texts]


def test_zh_split_examples(spark):
    texts = ["今天天气很好。我们去公园吧！", "他说“先停。再走”然后离开了。", "实验还在继续……结果尚未公布。", "“没有闭合。后面都在引号里。", "短。"]
    assert [len(r[0]) for r in values(spark, texts, T.zh_sentences("t"))] == [2, 1, 2, 1, 0]


def test_long_text_does_not_overflow(spark):
    text = ("字" * 50 + "，") * 6000 + "。"
    assert [len(r[0]) for r in values(spark, [text], T.zh_sentences("t"))] == [1]


def test_en_split_equals_plain_rule(spark):
    rng = random.Random(6)
    pieces = ["one", "two", "e.g.", "3.14", "Dr.", "end.", "\n", " ", " ", "?", "stop. "]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    def plain(t):
        parts = [re.sub(r"\s+", " ", p.strip()) for p in re.split(r"(?<=\.)\s+|\n+", t)]
        return [p for p in parts if p and len(p.split()) >= 5]
    assert [r[0] for r in values(spark, texts, T.en_sentences("t"))] == [plain(t) for t in texts]


def test_language(spark):
    assert [r[0] for r in values(spark, ["abc", "中文", "中文abc", "123", "中文ab"], T.main_language("t"))] == ["en", "zh", "en", "zh", "zh"]


def test_body_end_and_body(spark):
    heads = ["参考文献", "  致谢  ", "一、附录A", "正文中出现参考文献一词", "参考文献" + "字" * 30, ""]
    assert [r[0] for r in values(spark, heads, T.is_body_end("t"))] == [True, True, True, False, False, False]
    long = "字" * 120
    texts = ["|".join([long, "参考文献", "[1] 某"]), "|".join(["短文", "参考文献", "[1] 某"]), "|".join([long, "致谢", "谢" * 300])]
    got = [r[0] for r in values(spark, texts, T.body_of(F.split("t", r"\|")))]
    assert got[0] == long
    assert got[1] == "短文\n参考文献\n[1] 某"
    assert got[2] == long + "\n致谢\n" + "谢" * 300  # body below two fifths of the whole


def test_mattr_edges(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n)) for n in (0, 1, 49, 50, 51, 74, 75, 99, 100, 130)]
    def plain(t):
        w = re.findall(r"[一-鿿]{1,4}|[a-zA-Z]+", t)
        if len(w) < 50:
            return len(set(w)) / max(len(w), 1)
        v = [len(set(w[i:i + 50])) / 50 for i in range(0, len(w) - 49, 25)]
        return sum(v) / len(v)
    for (got,), t in zip(values(spark, texts, FE.mattr("t")), texts):
        assert got == pytest.approx(plain(t), abs=1e-12)


def test_template_hits(spark):
    texts = ["综上所述，研究赋能产业，赋能教育。", "we delve and delve; it is crucial", "没有套话"]
    rows = values(spark, texts, FE.hit_score(FE.template_hits("t")), F.size(FE.template_hits("t")))
    assert rows[0][0] == pytest.approx(1.2 + 1.3 * 2) and rows[0][1] == 2
    assert rows[1][0] == pytest.approx(1.3 * 2 + 1.2) and rows[2] == (0.0, 0)


def test_connectives_listed_twice_count_twice(spark):
    assert [r[0] for r in values(spark, ["此外因此", "However, thus thus"], FE.connective_count("t"))] == [3, 2]


def test_similarity_uses_pairs_without_overlap(spark):
    df = spark.createDataFrame([("今天天气", "天天气很"), ("abc", "今天")], "a string, b string")
    assert [r[0] for r in df.select(T.similarity("a", "b")).collect()] == [0.0, 0.0]
    df = spark.createDataFrame([("今天天气", "今天下雨")], "a string, b string")
    assert df.select(T.similarity("a", "b")).first()[0] == pytest.approx(1 / 3)


def test_report_meta(spark):
    text = "知网 AIGC检测\n报告编号：R_77\n疑似率: 45.5%\n字数：12,345\nAI特征字符数：99\n检测时间：2024-03-01 10:20:30\n篇名： 标题 \n作者：某人"
    m = values(spark, [text], R.report_meta("t"))[0][0]
    assert (m.platform, m.report_no, m.ai_rate, m.total_chars, m.ai_chars, m.title) == ("知网", "R_77", 45.5, 12345, 99, "标题")
    assert m.author_hash and "某人" not in str(m)


def test_file_names(spark):
    names = ["/a/x_检测报告_1.pdf", "/a/免费_PDF打印版_AIGC检测报告_[题目].pdf", "/a/题目].pdf"]
    assert [r[0] for r in values(spark, names, R.clean_file_title("t"))] == ["x", "免费_PDF打印版", "题目"]
    paths = ["/a/PaperYY.PDF", "/a/.git/PaperYY.pdf", "/a/PaperYY.txt", "/a/b/AIGC报告.html"]
    assert [r[0] for r in values(spark, paths, R.is_report_path("t"))] == [True, False, False, True]


def test_upper_case_by_character(spark):
    texts = ["Straße", "ﬁnal ŉ ΐ", "ᾳᾼ", "grün ǆ", "ß", "", "ßa\nƛ", "a\U00010d70b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.u for r in df.select("i", T.simple_upper("t").alias("u")).collect()}
    want = ["STRAẞE", "ﬁNAL ŉ ΐ", "ᾼᾼ", "GRÜN Ǆ", "ẞ", "", "ẞA\nƛ", "A\U00010d70B", None]
    assert [got[i] for i in range(len(want))] == want


def test_files_of_one_key_are_not_taken_for_each_other(spark):
    from textprov.sources.files import not_extracted
    files = spark.createDataFrame([("a/1", 23), ("a/12", 3), ("b", 1), (None, 1)], "path string, size long")
    done = files.filter("size = 23 OR path IS NULL").select("path", T.file_key("path", "size").alias("path_key"))
    assert sorted(r.path for r in not_extracted(files, done).collect()) == ["a/12", "b"]
    assert sorted(r.path for r in not_extracted(files, done.select("path_key")).filter("path IS NOT NULL").collect()) == ["b"]
