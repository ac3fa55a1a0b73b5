"""Inputs of the registered queries: columns Spark derives from the given tables, with the same derivation in SQL.

The tables hold no Chinese text, so Chinese operators run on the documents with letters mapped to Han characters and
some frequent words mapped to phrases and marks. Scores come from the md5 stand-in, classes from its other digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scores import stand_in
from ..functions.text import en_sentences, zh_sentences
from ..sources.tables import read_table

# literal replacements applied in order, then the letter map
PHRASES = [
    (". ", "。"), (" with ", "“先停。再走”"), (" by ", "，综上所述，"), (" this ", "值得注意的是，"), (" was ", "。一方面"),
    (" from ", "，另一方面"), (" for ", "在数字化的背景下，"), (" are ", "……"), (" at ", "；"), (" as ", "，同时"), (" und ", "此外"),
    (" on ", "赋能"), (" is ", "，因此"), ("ing ", "？"), (" be ", "！"), (" it ", "总的来说"),
]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HANS = "的了和与及在对为从以而于是也都就并其之将学研究方法数"


def han_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for old, new in PHRASES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.translate(c, LETTERS, HANS)


def han_sql(c: str) -> str:
    for old, new in PHRASES:
        c = f"replace({c}, '{old}', '{new}')"
    return f"translate({c}, '{LETTERS}', '{HANS}')"


def documents(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return read_table(spark, d, "documents", ["doc_id", "text", *extra])


def han_documents(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return documents(spark, d, *extra).withColumn("text", han_text("text"))


def en_rows(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """English-rule sentences of all documents: doc_id, sent_idx, sentence (five words or more)."""
    return documents(spark, d, *extra).select(
        "doc_id", *extra, F.posexplode(en_sentences("text")).alias("sent_idx", "sentence")
    )


def han_rows(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return han_documents(spark, d, *extra).select(
        "doc_id", *extra, F.posexplode(zh_sentences("text")).alias("sent_idx", "sentence")
    )


def class_of(c: Column | str) -> Column:
    """Class correlated with the stand-in score: 1 where two stand-ins add to more than one."""
    return (stand_in(c, 0) + stand_in(c, 2) > 1).cast("int")


def scored_rows(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    s = F.col("sentence")
    return (
        en_rows(spark, d, *extra).withColumn("p_stat", stand_in(s, 0)).withColumn("p_deep", stand_in(s, 1))
        .withColumn("p", stand_in(s, 0)).withColumn("label", class_of(s))
    )


def row_id() -> Column:
    """Sentence identity as text, unique over the table."""
    return F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sent_idx").cast("string"))


# --- the same in SQL ---------------------------------------------------------------------------------------------

WS = V.SPACE
# the sentence expressions without possessive marks, which the other engine neither has nor needs
ZH_SQL = r"(?s)(?:[^。？！…“「『]+|[“「『][^”」』]*(?:[”」』]|\z))*(?:[。？！]+|…+|\z)"
ZH_SEGMENT_SQL = r"(?s)(?:[^。？！“「『]+|[“「『][^”」』]*(?:[”」』]|\z))*(?:[。？！]+|\z)"


def trim_sql(c: str) -> str:
    return rf"regexp_replace({c}, '\A{WS}+|{WS}+\z', '', 'g')"


def squeeze_sql(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', ' ', 'g')"


def drop_sql(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', '', 'g')"


def en_list_sql(c: str, words: int = 5) -> str:
    marked = rf"regexp_replace({c}, '\.{WS}+', '.' || chr(1), 'g')"
    parts = rf"string_split_regex({marked}, '\x01|\n+')"
    return (
        f"list_filter(list_transform({parts}, lambda s: {squeeze_sql(trim_sql('s'))}), "
        f"lambda s: s <> '' AND len(string_split(s, ' ')) >= {words})"
    )


def zh_list_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '{ZH_SQL}'), lambda s: {trim_sql('s')}), lambda s: length(s) > 4)"


def zh_corpus_list_sql(c: str) -> str:
    segs = f"regexp_extract_all({c}, '{ZH_SEGMENT_SQL}')"
    parts = f"list_transform({segs}, lambda s: string_split(regexp_replace(s, '([;；])', '\\1' || chr(1), 'g'), chr(1)))"
    return f"list_filter(list_transform(flatten({parts}), lambda s: {trim_sql('s')}), lambda s: length(s) > 4)"


def stop_list_sql(c: str) -> str:
    return f"string_split(regexp_replace({c}, '([。！？；])', '\\1' || chr(1), 'g'), chr(1))"


def han_count_sql(c: str) -> str:
    return rf"length(regexp_replace({c}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'))"


def latin_count_sql(c: str) -> str:
    return f"length(regexp_replace({c}, '[^A-Za-z]', '', 'g'))"


def lang_sql(c: str) -> str:
    zh, en = han_count_sql(c), latin_count_sql(c)
    return f"CASE WHEN {zh} = 0 AND {en} > 0 THEN 'en' WHEN {zh} >= {en} THEN 'zh' ELSE 'en' END"


def matches_sql(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def occurrences_sql(c: str, word: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, '{word}', ''))) / {len(word)} AS BIGINT)"


def stand_in_sql(c: str, part: int = 0) -> str:
    return f"(CAST(('0x' || substr(md5({c}), {1 + 4 * part}, 4))::INT AS DOUBLE) / 65535.0::DOUBLE)"


def class_sql(c: str) -> str:
    return f"(CASE WHEN {stand_in_sql(c, 0)} + {stand_in_sql(c, 2)} > 1 THEN 1 ELSE 0 END)"


def rows_sql(list_sql: str, source: str = "documents", keep: str = "doc_id, source, lang") -> str:
    """Subquery of sentence rows from a list expression over ``text``."""
    return (
        f"(SELECT {keep}, CAST(i AS BIGINT) AS sent_idx, l[i + 1] AS sentence "
        f"FROM (SELECT {keep}, l, unnest(range(len(l))) AS i FROM (SELECT {keep}, {list_sql} AS l FROM {source})))"
    )


EN_ROWS = rows_sql(en_list_sql("text"))
HAN_ROWS = rows_sql(zh_list_sql(han_sql("text")))
SCORED_ROWS = (
    f"(SELECT *, {stand_in_sql('sentence', 0)} AS p_stat, {stand_in_sql('sentence', 1)} AS p_deep, "
    f"{stand_in_sql('sentence', 0)} AS p, {class_sql('sentence')} AS label FROM {EN_ROWS})"
)
ROW_ID = "CAST(doc_id AS VARCHAR) || '-' || CAST(sent_idx AS VARCHAR)"


def order_sql(ids: str, seed: int) -> str:
    return f"md5({ids} || '|{seed}')"


FUSE_SQL = (
    "CASE WHEN {b} IS NULL THEN {a} WHEN {a} IS NULL THEN {b} "
    "WHEN abs({a} - {b}) > 0.25 THEN {w} * {a} + (1 - {w}) * {b} ELSE ({a} + {b}) / 2 END"
)


def fuse_sql(a: str = "p_stat", b: str = "p_deep", w: str = "0.35::DOUBLE") -> str:
    return FUSE_SQL.format(a=a, b=b, w=w)
