"""Rule-based and stylometric features of a sentence or text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import _col, chars_of, count_of, has_han, is_chinese, let, occurrences, strip_space

HIT_TYPE = "array<struct<pattern:string,count:bigint,weight:double,desc:string>>"


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def needed_literals(pattern: str) -> list[str] | None:
    """Literals of which every match holds one: the longest of each alternative; None if the pattern is not that simple."""
    plain = re.sub(r"\[[^\]]*\](?:\{\d+,\d+\})?", "\0", pattern)
    if re.search(r"[\\()\[\]{}?*+.^$]", plain):
        return None
    literals = [max(alternative.split("\0"), key=len) for alternative in plain.split("|")]
    return literals if all(literals) else None


def may_match(c: Column, patterns: list[str]) -> Column:
    """False only where no pattern matches. Literals are searched as bytes, which an alternation of them is far from."""
    known = {p: needed_literals(p) for p in patterns}
    tests = [c.contains(w) for w in dict.fromkeys(w for words in known.values() for w in words or [])]
    rest = [p for p, words in known.items() if words is None]
    if rest:
        tests.append(c.rlike("(?U)" + _any_of(rest)))
    return reduce(Column.__or__, tests)


def phrase_hits(c: Column | str, patterns) -> Column:
    """The patterns that occur, with count, weight and description.

    ``may_match`` decides first, so most texts without a hit are not matched with every pattern.
    """
    c = _col(c)
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("pattern"),
                F.when(may_match(c, [p]), count_of(c, "(?U)" + p)).otherwise(F.lit(0).cast("bigint")).alias("count"),
                F.lit(float(w)).alias("weight"),
                F.lit(d).alias("desc"),
            )
            for p, w, d in patterns
        ]
    )
    some = may_match(c, [p for p, _, _ in patterns])
    if patterns is V.TEMPLATES_ZH:
        some = has_han(c) & some
    return F.when(some, F.filter(rows, lambda h: h["count"] > 0)).otherwise(F.array().cast(HIT_TYPE))


def hit_score(hits: Column | str) -> Column:
    """Weighted total of a hit list."""
    return F.aggregate(_col(hits), F.lit(0.0), lambda acc, h: acc + h["count"] * h["weight"])


def template_hits(c: Column | str, chinese: Column | None = None) -> Column:
    """Template hits with the pattern list of the text's language; ``chinese`` is given where it is known."""
    c = _col(c)
    return F.when(is_chinese(c) if chinese is None else chinese, phrase_hits(c, V.TEMPLATES_ZH)).otherwise(phrase_hits(c, V.TEMPLATES_EN))


def template_names(c: Column | str) -> Column:
    """Descriptions of the Chinese templates found in a sentence, in list order."""
    c = _col(c)
    found = F.array(*[F.when(may_match(c, [p]) & c.rlike(p), F.lit(d)) for p, _, d in V.TEMPLATES_ZH])
    some = has_han(c) & may_match(c, [p for p, _, _ in V.TEMPLATES_ZH])
    return F.when(some, F.filter(found, lambda d: d.isNotNull())).otherwise(F.array().cast("array<string>"))


def _sum_occurrences(c: Column, words: list[str]) -> Column:
    total = F.lit(0).cast("bigint")
    for w in words:
        total = total + occurrences(c, w)
    return F.when(may_match(c, words), total).otherwise(F.lit(0).cast("bigint"))


def connective_count(c: Column | str, chinese: Column | None = None) -> Column:
    c = _col(c)
    chinese = is_chinese(c) if chinese is None else chinese
    english = count_of(c, r"(?U)\b(?:" + "|".join(V.CONNECTIVES_EN) + r")\b")
    return F.when(chinese, _sum_occurrences(c, V.CONNECTIVES_ZH)).otherwise(english)


def connective_density(c: Column | str, chinese: Column | None = None) -> Column:
    c = _col(c)
    return connective_count(c, chinese) / F.greatest(F.length(c), F.lit(1))


def frequent_english_words(c: Column | str, chinese: Column | None = None) -> Column:
    """Occurrences of the frequent English words in the lower-cased text; zero for Chinese text."""
    c = _col(c)
    return F.when(is_chinese(c) if chinese is None else chinese, F.lit(0).cast("bigint")).otherwise(_sum_occurrences(F.lower(c), V.FREQUENT_WORDS_EN))


def is_long(c: Column | str) -> Column:
    return F.length(_col(c)) > V.LONG_SENTENCE


def is_short(c: Column | str) -> Column:
    return F.length(_col(c)) < V.SHORT_SENTENCE


def sentence_features(c: Column | str) -> Column:
    """All features of one sentence as a struct."""
    c = _col(c)
    return let(
        is_chinese(c),
        lambda chinese: let(
            template_hits(c, chinese),
            lambda hits: F.struct(
                F.length(c).cast("bigint").alias("len"),
                chinese.alias("is_chinese"),
                hit_score(hits).alias("template_score"),
                hits.alias("template_hits"),
                connective_density(c, chinese).alias("connective_density"),
                frequent_english_words(c, chinese).alias("ai_en_words"),
                is_long(c).alias("is_long"),
                is_short(c).alias("is_short"),
            ),
        ),
    )


def stock_phrase_hits(c: Column | str) -> Column:
    """How many different stock phrases occur; matched literally."""
    c = _col(c)
    n = F.lit(0).cast("bigint")
    for p in V.STOCK_PHRASES:
        n = n + c.contains(p).cast("bigint")
    return n


# --- style -------------------------------------------------------------------------------------------------------

def style_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(V.STYLE_TOKEN), F.lit(0))


def _mattr(tok: Column, window: int) -> Column:
    n = F.size(tok)
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(window // 2))
    ratios = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(tok, i + 1, F.lit(window)))) / F.lit(window))
    mean = let(ratios, lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / F.size(r))
    short = F.size(F.array_distinct(tok)) / F.greatest(n, F.lit(1))
    return F.when(n < window, short).otherwise(mean)


def _repetition(tok: Column) -> Column:
    n = F.size(tok)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_distinct(tok)) / n)


def mattr(c: Column | str, window: int = 50) -> Column:
    """Moving-average type-token ratio: windows of ``window`` tokens, half a window apart."""
    return let(style_tokens(c), lambda tok: _mattr(tok, window))


def repetition(c: Column | str) -> Column:
    """Share of tokens that repeat an earlier one."""
    return let(style_tokens(c), _repetition)


def punctuation_density(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == "", F.lit(0.0)).otherwise(chars_of(c, "，。、；：！？,.;:!?") / F.length(c))


def clause_variability(c: Column | str) -> Column:
    """Population standard deviation of clause lengths over their mean; zero below two clauses."""
    lens = F.transform(
        F.regexp_extract_all(_col(c), F.lit("[^，。；、：]+"), F.lit(0)),
        lambda s: F.length(strip_space(s)).cast("double"),
    )
    return F.aggregate(
        F.filter(lens, lambda n: n > 0),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.when(a["n"] < 2, F.lit(0.0)).otherwise(
            F.sqrt(F.greatest(a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]), F.lit(0.0))) / (a["s"] / a["n"])
        ),
    )


def function_word_density(c: Column | str) -> Column:
    c = _col(c)
    return chars_of(c, V.FUNCTION_CHARS) / F.greatest(F.length(c), F.lit(1))


def style_features(c: Column | str) -> Column:
    """The five style figures of a text; the text is tokenised once."""
    c = _col(c)
    return let(
        style_tokens(c),
        lambda tok: F.struct(
            _mattr(tok, 50).alias("mattr"),
            _repetition(tok).alias("repetition"),
            punctuation_density(c).alias("punct_density"),
            clause_variability(c).alias("clause_var"),
            function_word_density(c).alias("fw_density"),
        ),
    )
