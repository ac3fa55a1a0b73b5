"""Sentence annotations read out of report texts, styled runs and annotated HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import report_fields as R
from ..functions import scores as SC
from ..functions.text import drop_space, has_han, let, stop_sentences, strip_space

# Inline marks, page furniture and tags of annotated reports.
BODY_MARK = "原文内容"
INLINE_MARK = r"([\d.]+)%\((\d+)\)"
FURNITURE = r"(?U)—\s*\d+\s*—|https://cx\.cnki\.net|知网个人AIGC检测服务"
POPOVER = "aigc-detection-chance-popover"
EM_LEVEL = r'(?s)\A<em\b[^>]*?\bclass="(low|medium|high)(?=[\s"])'
EM_INNER = r"(?s)\A<em\b[^>]*>(.*?)</em>"
# what follows an em inside its own parent: text, inline tags and whole div elements, up to a popover or a block border
BLOCK = r"(?:div|p|li|ul|ol|dl|dd|dt|td|th|tr|table|section|article|header|footer|main|form|body|html|h[1-6])\b"
IS_POPOVER = r'<div\b[^>]*?\bclass="[^"]*' + POPOVER + r'[^"]*"[^>]*>'
SIBLINGS = r"(?s)\A((?:[^<]++|<(?!/?" + BLOCK + r")|(?!" + IS_POPOVER + r")<div\b[^>]*+>(?:[^<]++|<(?!/?div\b))*+</div>)*+)"
CHANCE = r"(?U)AI生成的可能性为[：:]\s*<i[^>]*>\s*([\d.]+)%"
CHANCE_PLAIN = r"(?U)AI生成的可能性为[：:]\s*([\d.]+)%"


#: Marks of a report that are placed together; runs of a paragraph that are joined together.
MARKS, RUN_CHUNK = 128, 4096
MARK = "array<struct<pct:double,n:int>>"


def inline_segments(reports: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Sentences of reports with inline ``pct%(chars)`` marks: ``ids, seg_idx, sent_idx, sentence, prob, label``.

    The marks give the percentage and length of consecutive pieces of the cleaned body; pieces are found by the running
    sum of the lengths before them, all inside the report's row and in blocks of marks.
    """
    at = F.instr(F.col(text), BODY_MARK)
    body = F.substr(F.col(text), at + len(BODY_MARK))
    slim = reports.filter(at > 0).select(*ids, body.alias("_body"))
    clean = drop_space(F.regexp_replace(F.regexp_replace("_body", INLINE_MARK, ""), FURNITURE, ""))
    chars = F.transform(F.regexp_extract_all("_body", F.lit(INLINE_MARK), F.lit(2)), lambda n: n.cast("int"))
    pcts = F.transform(F.regexp_extract_all("_body", F.lit(INLINE_MARK), F.lit(1)), lambda p: p.try_cast("double"))
    marks = F.arrays_zip(pcts.alias("pct"), chars.alias("n"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<pct:double,pos:int,n:int>>").alias("segs"))

    def pieces(block: Column) -> Column:
        """pct and text of the block's marks, by the running sum of the lengths before them."""
        segs = F.aggregate(
            block["marks"], zero,
            lambda a, m: F.struct(
                (a["pos"] + m["n"]).alias("pos"),
                F.concat(a["segs"], F.array(F.struct(m["pct"].alias("pct"), a["pos"].alias("pos"), m["n"].alias("n")))).alias("segs"),
            ),
            lambda a: a["segs"],
        )
        return F.transform(segs, lambda s: F.struct(s["pct"].alias("pct"), F.substr(block["body"], s["pos"] + 1, s["n"]).alias("piece")))

    def blocks(row: Column) -> Column:
        """The marks in blocks, each with its part of the text: work on a block does not grow with the report."""
        some = F.transform(F.sequence(F.lit(0), F.floor(F.size(row["marks"]) / MARKS).cast("int")), lambda k: F.slice(row["marks"], k * MARKS + 1, F.lit(MARKS)))
        none = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<struct<pos:int,n:int,marks:{MARK}>>").alias("blocks"))
        placed = F.aggregate(some, none, lambda a, b: let(F.aggregate(b, F.lit(0), lambda t, m: t + m["n"]), lambda n: F.struct(
            (a["pos"] + n).alias("pos"), F.concat(a["blocks"], F.array(F.struct(a["pos"].alias("pos"), n.alias("n"), b.alias("marks")))).alias("blocks"))), lambda a: a["blocks"])
        return F.transform(placed, lambda b: F.struct(F.substr(row["clean"], b["pos"] + 1, b["n"]).alias("body"), b["marks"].alias("marks")))

    rows = slim.select(*ids, F.posexplode(let(F.struct(clean.alias("clean"), marks.cast(MARK).alias("marks")), blocks)).alias("_k", "_b"))
    rows = rows.select(*ids, "_k", F.posexplode(pieces(F.col("_b"))).alias("_i", "s"))
    rows = rows.select(*ids, (F.col("_k") * MARKS + F.col("_i")).alias("seg_idx"), "s")
    rows = rows.select(*ids, "seg_idx", F.col("s.pct").alias("_pct"),
                       F.posexplode(stop_sentences(F.col("s.piece"), longer_than=3)).alias("sent_idx", "sentence"))
    return rows.filter(has_han("sentence")).select(
        *ids, "seg_idx", "sent_idx", "sentence", F.round(F.col("_pct") / 100, 4).alias("prob"), SC.tier("_pct").alias("label")
    )


def merge_runs(runs: DataFrame, keys: list[str] | None = None, position: str = "run_idx", text: str = "text", chunk: int = RUN_CHUNK) -> DataFrame:
    """Adjacent runs of one paragraph with the same colour label, joined: ``keys, grp, text, label, prob``.

    Near-white runs separate their neighbours; pieces need more than four characters before stripping, and Han.
    Runs are joined inside chunks of ``chunk`` positions first, then over the borders of chunks, so that no task holds a
    whole paragraph; only the number of changes and the outer labels of a chunk meet those of its paragraph.
    """
    keys = keys or ["doc_id", "para_idx"]

    def joined(at: str, of: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(of).alias("t")))), lambda x: x["t"]), "")

    rows = runs.filter(F.col(text) != "").withColumn("label", R.colour_label("r", "g", "b"))
    rows = rows.select(*keys, F.floor(F.col(position) / chunk).alias("_chunk"), F.col(position).alias("_at"), "label",
                       F.when(F.col("label") != "skip", F.col(text)).otherwise("").alias("_text"))
    order = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    changed = F.coalesce((F.lag("label").over(order) != F.col("label")).cast("int"), F.lit(0))
    rows = rows.withColumn("_new", changed).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_chunk", "_g", "label").agg(joined("_at", "_text").alias("_text"))
    ends = rows.groupBy(*keys, "_chunk").agg(F.max("_g").alias("_last"), F.min_by("label", "_at").alias("_head"), F.max_by("label", "_at").alias("_tail"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    border = F.coalesce((F.lag("_tail").over(along) != F.col("_head")).cast("bigint"), F.lit(0))
    step = border + F.coalesce(F.lag("_last").over(along), F.lit(0))
    ends = ends.withColumn("_step", step).withColumn("_before", F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.filter("_before > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_chunk").alias("__chunk"), "_before")
    same = F.col("_chunk").eqNullSafe(F.col("__chunk"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    parts = parts.join(ends, same, "left").withColumn("grp", F.col("_g") + F.coalesce("_before", F.lit(0)))
    merged = parts.filter(F.col("label") != "skip").groupBy(*keys, "grp", "label").agg(joined("_chunk", "_text").alias("text"))
    return (
        merged.filter((F.length("text") > 4) & has_han("text"))
        .withColumn("text", strip_space("text"))
        .withColumn("prob", R.label_probability("label"))
    )


def plain_text(html: Column) -> Column:
    """Text pieces between tags, stripped and joined by single spaces; the basic entities are decoded."""
    parts = F.filter(F.transform(F.split(html, r"(?s)<[^>]*>"), strip_space), lambda s: s != "")
    out = F.array_join(parts, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def _em_spans(html: str) -> Column:
    """level, inner, tail (text of the siblings up to the next em), pop (the next popover in the same parent) of every em
    of the three classes. The page is cut once at its em tags; an em without popover of its own takes that of the next one,
    unless a block border lies between."""
    pieces = F.filter(F.split(F.col(html), r"(?=<em\b)"), lambda p: p.startswith("<em"))

    def parsed(p: Column) -> Column:
        after = F.regexp_replace(p, EM_INNER, "")
        tail = F.regexp_extract(after, SIBLINGS, 1)
        rest = F.substr(after, F.length(tail) + 1)
        pop = F.when(rest == "", F.lit(None)).when(rest.rlike(r"\A" + IS_POPOVER), F.regexp_extract(rest, r"(?s)\A<div\b[^>]*>(.*?)</div>", 1)).otherwise("")
        return F.struct(F.regexp_extract(p, EM_LEVEL, 1).alias("level"), F.regexp_extract(p, EM_INNER, 1).alias("inner"), tail.alias("tail"), pop.alias("pop"))

    start = F.struct(F.lit("").alias("pop"), F.array().cast("array<struct<level:string,inner:string,tail:string,pop:string>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        pop = F.coalesce(s["pop"], a["pop"])
        return F.struct(pop.alias("pop"), F.concat(a["out"], F.array(F.struct(s["level"].alias("level"), s["inner"].alias("inner"), s["tail"].alias("tail"), pop.alias("pop")))).alias("out"))

    spans = F.aggregate(F.reverse(F.transform(pieces, parsed)), start, step, lambda a: F.reverse(a["out"]))
    return F.filter(spans, lambda s: s["level"] != "")


def annotated_spans(pages: DataFrame, ids: list[str], html: str = "html", fallback: bool = False) -> DataFrame:
    """Annotated spans of report pages: ``ids, span_idx, text, level, pct``.

    A span is an ``em`` of class low, medium or high; its percentage is in the next popover in the same parent. With
    ``fallback`` a plain percentage up to the next span is used where the popover has none. Tags are found by expression,
    not by a document tree; a parent ends at the next border of a block element.
    """
    zipped = _em_spans(html)
    rows = pages.filter(F.col(html).contains("<em")).select(*ids, F.posexplode(zipped).alias("span_idx", "s"))
    pct = F.nullif(F.regexp_extract("s.pop", CHANCE, 1), F.lit(""))
    if fallback:
        pct = F.coalesce(pct, F.nullif(F.regexp_extract("s.tail", CHANCE_PLAIN, 1), F.lit("")))
    return rows.select(*ids, "span_idx", plain_text(F.col("s.inner")).alias("text"), F.col("s.level").alias("level"),
                       pct.try_cast("double").alias("pct")).filter((F.col("text") != "") & F.col("pct").isNotNull())


def span_annotations(pages: DataFrame, ids: list[str], html: str = "html") -> DataFrame:
    """Training annotations of report pages: Han text longer than three characters, probability and tier."""
    spans = annotated_spans(pages, ids, html).filter((F.length("text") > 3) & has_han("text"))
    return spans.select(*ids, "span_idx", "text", F.round(F.col("pct") / 100, 4).alias("prob"), SC.tier("pct").alias("label"))


def page_reports(pages: DataFrame, ids: list[str], html: str = "html") -> DataFrame:
    """One nested record per report page: key figures, paragraph probabilities, annotated sentences."""
    zipped = _em_spans(html)
    spans = F.transform(
        zipped,
        lambda s: F.struct(
            plain_text(s["inner"]).alias("text"),
            s["level"].alias("level"),
            F.coalesce(
                F.nullif(F.regexp_extract(s["pop"], CHANCE, 1), F.lit("")),
                F.nullif(F.regexp_extract(s["tail"], CHANCE_PLAIN, 1), F.lit("")),
            ).try_cast("double").alias("prob"),
        ),
    )
    kept = F.filter(spans, lambda s: s["prob"].isNotNull() & (s["text"] != ""))
    return pages.select(*ids, let(plain_text(F.col(html)), lambda t: R.page_meta(t)).alias("m"), kept.alias("sentences")).select(
        *ids, "m.*", "sentences"
    )


def header_fields(texts: DataFrame, ids: list[str], text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Header fields as a map, the first occurrence of a key wins, and the first section percentage.

    Names, numbers and supervisors are hashed; ``keys`` restricts the map.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(R.HEADER_FIELD), F.lit(1)).alias("k"),
        F.regexp_extract_all(text, F.lit(R.HEADER_FIELD), F.lit(2)).alias("v"),
    )

    def build(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda x: x["k"]))
        if keys:
            names = F.filter(names, lambda k: k.isin(keys))
        values = F.transform(names, lambda k: strip_space(F.get(F.filter(found, lambda x: x["k"] == k), F.lit(0))["v"]))
        guarded = F.zip_with(names, values, lambda k, v: F.when(k.isin(R.PRIVATE_KEYS), F.sha2(v, 256)).otherwise(v))
        return F.map_from_arrays(names, guarded)

    pct = F.nullif(F.regexp_extract(text, "(?U)" + R.SECTION_RATE, 3), F.lit(""))
    return texts.select(*ids, let(pairs, build).alias("fields"), pct.try_cast("double").alias("section_pct"))
