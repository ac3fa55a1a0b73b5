"""Text expressions: counting, language routing, sentence splitting, cleaning, headings, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often and however deep the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(c: Column | str, pattern: str) -> Column:
    """Number of non-overlapping matches of a regular expression, as bigint."""
    return F.regexp_count(_col(c), F.lit(pattern)).cast("bigint")


def occurrences(c: Column | str, literal: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    c = _col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("bigint")


def chars_outside(c: Column | str, run: str) -> Column:
    """Number of characters left when the runs matching ``run`` are taken out."""
    return F.length(F.regexp_replace(_col(c), run, "")).cast("bigint")


def chars_of(c: Column | str, chars: str) -> Column:
    """Number of characters that are among ``chars``; a look-up each, where a regular expression asks for one after the other."""
    c = _col(c)
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("bigint")


def strip_space(c: Column | str) -> Column:
    """Remove white space (the full Unicode set) at both ends."""
    return F.btrim(_col(c), F.lit(V.SPACE_CHARS))


def collapse_space(c: Column | str) -> Column:
    """Every run of white space becomes one space; single spaces are not touched."""
    return F.regexp_replace(_col(c), f"{V.FAST_SPACE}{{2,}}|(?! ){V.FAST_SPACE}", " ")


def drop_space(c: Column | str) -> Column:
    """Normalised key of a text: all white space removed."""
    return F.regexp_replace(_col(c), V.FAST_SPACE + "+", "")


def han_count(c: Column | str) -> Column:
    return chars_outside(c, V.NOT_HAN)


def latin_count(c: Column | str) -> Column:
    return chars_outside(c, V.NOT_LATIN)


def main_language(c: Column | str) -> Column:
    """``en`` if Latin letters outnumber Han characters (or there are only Latin letters), else ``zh``."""
    one_script = F.when(_col(c).rlike("[A-Za-z]"), "en").otherwise("zh")
    return F.when(~has_han(c), one_script).when(latin_count(c) > han_count(c), "en").otherwise("zh")


def is_chinese(c: Column | str) -> Column:
    c = _col(c)
    return han_count(c) / F.greatest(F.length(c), F.lit(1)) > 0.3


def has_han(c: Column | str) -> Column:
    return _col(c).rlike(V.HAN)


def is_latin(c: Column | str) -> Column:
    return _col(c).rlike("[A-Za-z]") & ~has_han(c)


def latin_outnumbers_han(c: Column | str) -> Column:
    return latin_count(c) > han_count(c)


def is_plain_english(c: Column | str, min_chars: int = 30, min_letters: int = 40) -> Column:
    """Printable ASCII throughout, at least ``min_chars`` long, more than ``min_letters`` letters; null counts as empty."""
    s = strip_space(F.coalesce(_col(c), F.lit("")))
    return s.rlike(rf"^[ -~]{{{min_chars},}}\z") & (latin_count(s) > min_letters)


def word_count(c: Column | str) -> Column:
    """Words of a white-space-collapsed, stripped text."""
    c = _col(c)
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


# --- sentence splitting ------------------------------------------------------------------------------------------

def _long_enough(parts: Column, longer_than: int) -> Column:
    return F.filter(F.transform(parts, strip_space), lambda s: F.length(s) > longer_than)


def zh_sentences(c: Column | str) -> Column:
    """Chinese sentences: runs of 。？！ and of … end a sentence unless inside quotes; at least five characters."""
    return _long_enough(F.regexp_extract_all(_col(c), F.lit(V.ZH_SENTENCE), F.lit(0)), 4)


def zh_corpus_sentences(c: Column | str) -> Column:
    """Corpus variant: … does not end a sentence, a semicolon does even inside quotes."""
    segments = F.regexp_extract_all(_col(c), F.lit(V.ZH_SEGMENT), F.lit(0))
    return _long_enough(F.flatten(F.transform(segments, lambda s: F.split(s, "(?<=[;；])"))), 4)


def en_sentences(c: Column | str, min_words: int = 5) -> Column:
    """English sentences: cut after a full stop with white space, or at line breaks; ``min_words`` words at least."""
    parts = F.transform(F.split(_col(c), V.EN_CUT), lambda s: collapse_space(strip_space(s)))
    return F.filter(parts, lambda s: (s != "") & (word_count(s) >= min_words))


def stop_sentences(c: Column | str, longer_than: int | None = None, min_han: int = 0, first: int | None = None) -> Column:
    """Cut after each 。！？； keeping it. ``longer_than`` strips and filters by length; ``first`` keeps the head."""
    parts = F.split(_col(c), V.STOP_CUT)
    if longer_than is not None:
        out = _long_enough(parts, longer_than)
    else:
        out = F.filter(parts, lambda s: strip_space(s) != "")
    if min_han:
        out = F.filter(out, lambda s: han_count(s) >= min_han)
    return out if first is None else F.slice(out, 1, first)


def service_sentences(c: Column | str, lang: Column | None = None) -> Column:
    """Splitter of the detection path, chosen by the main language of the text (computed unless given)."""
    lang = main_language(c) if lang is None else lang
    return F.when(lang == "en", en_sentences(c)).otherwise(zh_sentences(c))


SPLITTERS = {
    "service": service_sentences,
    "zh": zh_sentences,
    "zh_corpus": zh_corpus_sentences,
    "en": en_sentences,
    "stop": stop_sentences,
}


def clean_sentence(c: Column | str, lang: Column | str | None = None) -> Column:
    """Collapse white space, strip list marks, then null unless long enough for its language (6 Han / 8 words)."""
    lang = F.lit(lang) if isinstance(lang, str) else lang

    def kept(t: Column) -> Column:
        zh_ok = han_count(t) >= 6
        en_ok = is_latin(t) & (F.size(F.filter(F.split(t, " "), lambda w: w != "")) >= 8)
        if lang is None:
            return F.when(has_han(t), F.when(zh_ok, t)).when(en_ok, t)
        return F.when((lang == "zh") & zh_ok, t).when((lang == "en") & en_ok, t)

    return let(F.regexp_replace(F.trim(collapse_space(_col(c))), r"^[·—•*#]+|[·—•*#]+\z", ""), kept)


# --- body extraction ---------------------------------------------------------------------------------------------

def is_body_end(c: Column | str) -> Column:
    """A short line that starts with, or has within its first six characters, a marker such as 参考文献."""
    t = strip_space(_col(c))
    marked = F.lit(False)
    for m in V.BODY_END_MARKERS:
        marked = marked | t.startswith(m) | F.substring(t, 1, 6).contains(m)
    return (t != "") & (F.length(t) <= 25) & marked


def body_of(paragraphs: Column | str) -> Column:
    """Body text of a paragraph array: what precedes the first end heading, with the two fall-backs to the full text."""
    p = _col(paragraphs)
    full = F.array_join(p, "\n")

    def cut_at(cut: Column) -> Column:
        head = strip_space(F.array_join(F.slice(p, F.lit(1), F.greatest(cut - 1, F.lit(0))), "\n"))
        return F.when(cut == 0, strip_space(full)).otherwise(
            let(head, lambda h: F.when(F.length(h) < 100, full).otherwise(h))
        )

    floor = F.greatest(F.lit(100.0), F.length(strip_space(full)) * F.lit(0.4))
    first_end = F.array_position(F.transform(p, is_body_end), F.lit(True)).cast("int")
    return let(cut_at(first_end), lambda b: F.when(F.length(strip_space(b)) < floor, full).otherwise(b))


# --- line and title tests ----------------------------------------------------------------------------------------

# Heading lines.
HEADING_PATTERNS = [
    r"^\s*\d+(\.\d+)*[\s、.．]",
    r"^\s*（[一二三四五六七八九十]+）",
    r"^\s*[一二三四五六七八九十]+[\s、，,]",
    r"^\s*(摘要|关键词|目录|参考文献|致谢|绪论|引言|结论|abstract|keywords|作者简介|基金项目)",
]
# Lines that are not body text.
REFERENCE_PATTERN = (
    r"\[\d+\]\s|\b\[[JMDCNEK]\]|\b\[EB/OL\]|\b\[J/OL\]|\b(20\d\d)[,，.]\d+.*?[:：]|^(参考文献|references?)\s*[:：]?"
)
METADATA_PATTERN = (
    r"^(参考文献|致\s*谢|摘\s*要|目\s*录|content|abstract|keywords|作者简介|基金项目|收稿|录用|"
    r"本\s*人\s*签\s*名|指导教师签名|学位论文|原创性声明|知识产权声明|分类号|UDC|论文类别|学校代码|学\s*号|答辩日期)"
)
TITLE_SUFFIX_PATTERN = r"(论文模版|论文模板|：?检测报告|(1)(\.docx)?$)"
HEADER_PATTERN = (
    r"(?iU)(UNIVERSITY|NANCHANG|届高等学历|摘要|目录|参考文献|致谢|关键词|^[0-9]{3,}|^\s*[A-Za-z ]{10,}\s*\z)"
)
BOILERPLATE_TITLE_PATTERN = r"(毕业论文|毕业设计|学位论文|继续教育|自学考试|本科|大学|学院|学校)"


def is_heading(c: Column | str) -> Column:
    s = strip_space(F.coalesce(_col(c), F.lit("")))
    hit = F.length(s) < 8
    for p in HEADING_PATTERNS:
        hit = hit | s.rlike("(?U)" + p)
    return hit


def is_contaminated(c: Column | str) -> Column:
    """Reference entries, covers, signatures and other non-body lines; empty and very short lines too."""
    s = strip_space(F.coalesce(_col(c), F.lit("")))
    return (
        (F.length(s) < 8)
        | s.rlike("(?Uid)" + REFERENCE_PATTERN)
        | s.rlike(r"(?U)^\s*\[\d+\]")
        | s.rlike("(?Uid)" + METADATA_PATTERN)
        | s.rlike(TITLE_SUFFIX_PATTERN)
    )


def has_page_header(c: Column | str) -> Column:
    return _col(c).rlike(HEADER_PATTERN)


def document_title(c: Column | str) -> Column:
    """First line of eight or more characters with six Han characters in a row, cut to forty; null if there is none."""
    lines = F.filter(
        F.transform(F.split(_col(c), "\n"), strip_space),
        lambda s: (F.length(s) >= 8) & s.rlike(V.HAN + "{6,}"),
    )
    return F.substring(F.get(lines, F.lit(0)), 1, 40)


def is_boilerplate_title(c: Column | str) -> Column:
    return _col(c).rlike(BOILERPLATE_TITLE_PATTERN)


# --- pairs -------------------------------------------------------------------------------------------------------

HAN_FIRST, HAN_SIZE = 0x4E00, 0x5200


def han_bigrams(c: Column | str) -> Column:
    """Distinct pairs of Han characters, taken without overlap."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(V.HAN + "{2}"), F.lit(0)))


def han_bigram_codes(c: Column | str) -> Column:
    """The distinct pairs of ``han_bigrams`` as numbers: two code points in one int."""
    code = lambda s: (F.ascii(s) - HAN_FIRST) * HAN_SIZE + F.ascii(F.substring(s, 2, 1)) - HAN_FIRST
    return F.transform(han_bigrams(c), code)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct-element arrays, zero if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity(a: Column | str, b: Column | str) -> Column:
    return let(han_bigrams(a), lambda x: let(han_bigrams(b), lambda y: jaccard(x, y)))


def length_ratio(src: Column | str, tgt: Column | str) -> Column:
    return F.length(_col(tgt)) / F.greatest(F.length(_col(src)), F.lit(1))


def length_ratio_ok(src: Column | str, tgt: Column | str, low: float = 0.4, high: float = 2.5) -> Column:
    return length_ratio(src, tgt).between(low, high)


LENGTH_GAP = 0.6


def length_gap_ok(src: Column | str, tgt: Column | str, below: float = LENGTH_GAP) -> Column:
    src, tgt = _col(src), _col(tgt)
    return F.abs(F.length(tgt) - F.length(src)) / F.greatest(F.length(src), F.lit(1)) < below


def reference_ok(src: Column | str, tgt: Column | str) -> Column:
    """The target may not bring in numbering, nor more than one extra Latin word."""
    src, tgt = F.coalesce(_col(src), F.lit("")), F.coalesce(_col(tgt), F.lit(""))
    number_mark = r"(?U)[（(]\s*[0-9一二三四五]+\s*[）)]|^\s*\d+[\.、]"
    words = r"[A-Za-z]{2,}"
    return (
        (src != "")
        & (tgt != "")
        & ~((count_of(tgt, number_mark) > 0) & (count_of(src, number_mark) == 0))
        & (count_of(tgt, words) <= count_of(src, words) + 1)
    )


# characters whose full upper case is several characters, and letters that have an upper case only since Unicode 16
_UPPER_ALONE = "".join(chr(i) for i in range(0x10000) if len(chr(i).upper()) > 1) + "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
_UPPER_THERE = "".join("\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 and len(c.upper()) > 1 else c for c in _UPPER_ALONE)


def simple_upper(c: Column | str) -> Column:
    """Upper case by character, so that no text changes its length: ß becomes ẞ, where Spark's ``upper`` gives SS."""
    c = _col(c)
    parts = F.regexp_extract_all(c, F.lit(f"(?s)[{_UPPER_ALONE}]++|[^{_UPPER_ALONE}]++"), F.lit(0))
    one = lambda p: F.when(p.rlike(f"^[{_UPPER_ALONE}]"), F.translate(p, _UPPER_ALONE, _UPPER_THERE)).otherwise(F.upper(p))
    return F.when(c.isNotNull(), F.array_join(F.transform(parts, one), ""))


def text_hash(c: Column | str) -> Column:
    return F.md5(_col(c))


def file_key(path: Column | str, size: Column | str) -> Column:
    """Content key of a file: sha1 over path and size."""
    return F.sha1(F.concat(_col(path), _col(size).cast("string")))
