"""Fields, platforms and labels read out of report texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import _col, strip_space

# Field patterns of annotated reports.
REPORT_NO = r"(?:NO|编号|报告编号)[：:]\s*([A-Za-z0-9_]+)"
RATE_PATTERNS = [r"AI特征值[：:]\s*([\d.]+)%", r"疑似率[：:]\s*([\d.]+)%", r"AIGC总体疑似度[^0-9]{0,8}\s*([\d.]+)%"]
META_RATE_PATTERNS = [r"AI特征值[：:]\s*([\d.]+)%", r"AIGC总体疑似度[^0-9]{0,8}\s*([\d.]+)%", r"疑似度[：:]\s*([\d.]+)%"]
TOTAL_CHARS = r"(?:字数|总字符数)[：:]\s*([\d,]+)"
AI_CHARS = r"AI特征字符数[：:]\s*([\d]+)"
DETECT_TIME = r"检测时间[：:]\s*([\d-]+ [\d:]+)"
TITLE = r"篇名[：:]\s*([^\n]+)"
AUTHOR = r"作者[：:]\s*([^\n]+)"
WORDS = r"字数[：:]\s*([\d,]+)"
SENTENCES = r"句子数[：:]\s*(\d+)"
PARAGRAPHS = r"段落数[：:]\s*(\d+)"
CHECKED_TITLE = r"检测文献[：:]\s*AIGC文档检测（\s*(.*?)\s*）"
PARAGRAPH_RATE = r"该段落可能为AI生成的概率为[：:]\s*([\d.]+)%"
SENTENCE_MARKS = r"AI生成的可能性为|疑似AIGC生成|该句子为AI生成|人工撰写占比"
HEADER_FIELD = r"(姓名|题目|专业|学校|学号|班级|指导教师|学院)[：:]\s*([^\n]{1,30})"
SECTION_RATE = r"(\d+)/(\d+)\s+\n?([\d.]+)%"
PRIVATE_KEYS = ["姓名", "学号", "指导教师"]


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group, null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), "(?U)" + pattern, group), F.lit(""))


def first_of(c: Column | str, patterns: list[str]) -> Column:
    return F.coalesce(*[first_match(c, p) for p in patterns])


# Platforms and the words that show them; the first rule that holds wins, a tuple needs all of its words.
INGEST_PLATFORMS = [
    ("知网", [("cx.cnki.net",), ("知网", "AIGC检测")]),
    ("PaperPass/PaperYY", [("PaperPass",), ("PaperYY",)]),
    ("维普", [("维普",), ("cqvip",)]),
    ("超星/大雅", [("超星",), ("学习通",), ("大雅",)]),
    ("万方", [("万方",), ("wanfang",)]),
    ("原文对照", [("原文对照",), ("人工撰写占比",)]),
]
META_PLATFORMS = [
    ("zhihu", [("cx.cnki.net",), ("知网", "AIGC检测")]),
    ("paperpass", [("PaperPass",), ("PaperYY",)]),
    ("duizhao", [("原文对照",), ("人工撰写占比",)]),
    ("aigc_detect", [("AIGC检测",)]),
]


def _platform(c: Column | str, rules: list) -> Column:
    out = F.lit("unknown")
    for name, words in reversed(rules):
        holds = reduce(Column.__or__, [reduce(Column.__and__, [_col(c).contains(w) for w in some]) for some in words])
        out = F.when(holds, name).otherwise(out)
    return out


def ingest_platform(c: Column | str) -> Column:
    """Platform by the first rule that holds (six platforms)."""
    return _platform(c, INGEST_PLATFORMS)


def meta_platform(c: Column | str) -> Column:
    """Platform by the shorter rule list (four platforms)."""
    return _platform(c, META_PLATFORMS)


def _integer(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("bigint")


def report_meta(c: Column | str) -> Column:
    """Key figures of a report. The author is kept as a hash only."""
    c = _col(c)
    return F.struct(
        ingest_platform(c).alias("platform"),
        first_match(c, REPORT_NO).alias("report_no"),
        first_of(c, RATE_PATTERNS).try_cast("double").alias("ai_rate"),
        _integer(first_match(c, TOTAL_CHARS)).alias("total_chars"),
        _integer(first_match(c, AI_CHARS)).alias("ai_chars"),
        first_match(c, DETECT_TIME).alias("detect_time"),
        F.try_to_timestamp(first_match(c, DETECT_TIME)).alias("detected_at"),
        strip_space(first_match(c, TITLE)).alias("title"),
        F.sha2(strip_space(first_match(c, AUTHOR)), 256).alias("author_hash"),
    )


def scan_meta(c: Column | str, path: Column | str) -> Column:
    """Key figures of a scanned report with flags and mark counts; the title falls back to the cleaned file name."""
    c = _col(c)
    return F.struct(
        meta_platform(c).alias("platform"),
        F.coalesce(strip_space(first_match(c, TITLE)), clean_file_title(path)).alias("title"),
        first_of(c, META_RATE_PATTERNS).try_cast("double").alias("ai_rate"),
        first_match(c, DETECT_TIME).alias("date"),
        c.contains("原文内容").alias("has_yuanwen"),
        c.contains("片段").alias("has_fragments"),
        F.regexp_count(c, F.lit(SENTENCE_MARKS)).cast("bigint").alias("sent_markers"),
        F.substring(c, 1, 90).alias("text_sample"),
    )


def page_meta(c: Column | str) -> Column:
    """Key figures of an annotated report page, with the probabilities of its paragraphs."""
    c = _col(c)
    return F.struct(
        first_match(c, RATE_PATTERNS[1]).try_cast("double").alias("total_rate"),
        _integer(first_match(c, WORDS)).alias("words"),
        first_match(c, SENTENCES).try_cast("bigint").alias("n_sents"),
        first_match(c, PARAGRAPHS).try_cast("bigint").alias("n_paras"),
        strip_space(first_match(c, CHECKED_TITLE)).alias("title"),
        F.regexp_extract_all(c, F.lit("(?U)" + PARAGRAPH_RATE), F.lit(1)).cast("array<double>").alias("para_probs"),
    )


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)\z", 1)


def clean_file_title(path: Column | str) -> Column:
    """Title from a report file name: suffix, report markers and brackets removed; the file name if nothing is left."""
    base = base_name(path)
    t = F.regexp_replace(base, r"(?i)\.pdf$", "")
    t = F.regexp_replace(
        t, r"[_\-]+(全文报告|原文对照报告|AIGC检测报告|AIGC存档报告|AIGC_全文报告单|检查报告|检测报告).*$", ""
    )
    t = F.regexp_replace(t, r"^免费_PDF打印版_AIGC检测报告_?\[?", "")
    t = strip_space(F.regexp_replace(t, r"[\]\)]+$", ""))
    return F.when(t == "", base).otherwise(t)


def is_report_path(path: Column | str) -> Column:
    """A report by extension and name key, outside the folders that are never searched."""
    path = _col(path)
    base = base_name(path)
    named = F.lit(False)
    for k in V.REPORT_NAME_KEYS:
        named = named | base.contains(k) | F.lower(base).contains(k)
    folders = "|".join(f.replace(".", r"\.") for f in V.PRUNED_FOLDERS)
    pruned = path.rlike(rf"(?:\A|/)(?:{folders}|\.[^/]*)/")
    return base.rlike(r"(?i)\.(pdf|docx|html?)$") & named & ~pruned


def generator_of(path: Column | str, prefix: str = "CReD_paper_") -> Column:
    """Generator named in a sample file's name."""
    return F.replace(F.replace(base_name(path), F.lit(prefix), F.lit("")), F.lit(".csv"), F.lit(""))


def paired_source_class(name: Column | str) -> Column:
    """Text class by file-name prefix of a paired sample file, null for files that are not used."""
    n = _col(name)
    return (
        F.when(n.startswith("arxiv") | n.startswith("peerread"), "M4-en-academic")
        .when(n.startswith("qazh"), "M4-zh-qa")
        .when(n.startswith("wikipedia"), "M4-en-wiki")
    )


def paired_generator(name: Column | str) -> Column:
    n = _col(name)
    cut = F.instr(n, "_")
    return F.when(cut > 0, F.substr(n, cut + 1)).otherwise("?")


def colour_label(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Label of a text run by its colour; no colour means human, near-white is skipped. The limits are fixed values."""
    r, g, b = _col(r), _col(g), _col(b)
    return (
        F.when(r.isNull() | g.isNull() | b.isNull(), "human")
        .when((r < 60) & (g < 60) & (b < 60), "human")
        .when((r > 170) & (g > 170) & (b > 170), "skip")
        .when((r > 220) & (g < 60) & (b < 60), "high")
        .when((r > 220) & (g > 120) & (g < 180) & (b < 40), "medium")
        .when((r > 140) & (r < 180) & (g > 120) & (g < 170) & (b > 210), "low")
        .otherwise("human")
    )


def label_probability(label: Column | str) -> Column:
    label = _col(label)
    return F.when(label == "high", 0.8).when(label == "medium", 0.5).when(label == "low", 0.22).when(label == "human", 0.15)
