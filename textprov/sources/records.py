"""Record parsers: JSON lines, sample files and paired texts. Each takes a DataFrame, so any reader can feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions import report_fields as R
from ..functions.text import clean_sentence, en_sentences, has_han, is_latin, let, strip_space, zh_corpus_sentences
from ..operators.scale import top_n_per_group

ANNOTATION = "text string, prob double, label string, title string, source string, generator string, lang string, guard string, deep_prob double"


def parse_json_lines(lines: DataFrame, record: str = ANNOTATION, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Records of JSON lines: a line may be a record, a list of records or ``{"sentences": [...]}``.

    Lines are parsed as VARIANT. Empty and malformed lines are skipped, as are list items that are no records; a record with
    one key twice counts as malformed. A missing field, or one that cannot be cast to its type, is null. ``keep`` names
    columns of ``lines`` to carry along.
    """
    keep = keep or []
    rows = lines.select(*keep, parsed_json(value).alias("_v")).filter(F.col("_v").isNotNull())
    items = F.coalesce(
        F.try_variant_get("_v", "$", "array<variant>"),
        F.when(F.try_variant_get("_v", "$.text", "string").isNull(), F.try_variant_get("_v", "$.sentences", "array<variant>")),
        F.array("_v"),
    )
    rows = rows.select(*keep, F.explode(items).alias("_r")).filter(_is_record("_r"))
    fields = [f.split() for f in record.split(",")]
    return rows.select(*keep, *[F.try_variant_get("_r", f"$.{name}", kind).alias(name) for name, kind in fields])


def parsed_json(value: Column | str) -> Column:
    """One JSON value as VARIANT; null for anything else, text after the value included."""
    # the parser stops at the end of the first value, so it reads a list that ends with a mark: no mark, no single value
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), strip_space(value), F.lit(', "end"]'))), "$", "array<variant>")
    marked = lambda a: (F.size(a) == 2) & (F.try_variant_get(F.get(a, F.lit(1)), "$", "string") == "end")
    return let(items, lambda a: F.when(marked(a), F.get(a, F.lit(0))))


def _is_record(v: Column | str) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def read_json_lines(spark: SparkSession, paths: str | list[str], record: str = ANNOTATION) -> DataFrame:
    """JSON-lines files; a path without files gives no rows."""
    schema_only = spark.createDataFrame([], "value string")
    try:
        lines = spark.read.text(paths)
    except Exception as e:  # the reader reports a missing path while the plan is built
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = schema_only
    return parse_json_lines(lines, record)


def _explode_clean(rows: DataFrame, splitter, lang: Column | str | None, keep: list[str]) -> DataFrame:
    """Sentences are cleaned in their array: a filter on a column of its own would make the optimiser clean each twice."""
    cleaned = F.transform(splitter, lambda s: clean_sentence(s, lang))
    return rows.select(*keep, F.posexplode(cleaned).alias("sent_idx", "text")).filter(F.col("text").isNotNull())


def generator_samples(rows: DataFrame) -> DataFrame:
    """Abstracts of one generator per file to sentences: ``path, text, label`` in, label 0 = AI, 1 = human.

    Rows without text or with a label that is not a whole number are skipped.
    """
    label = strip_space("label").try_cast("int")
    ok = rows.withColumn("_y", label).withColumn("_t", strip_space("text")).filter((F.col("_t") != "") & F.col("_y").isNotNull())
    ok = ok.select("row_id", R.generator_of("path").alias("generator"), (F.col("_y") == 0).alias("is_ai"), "_t")
    out = _explode_clean(ok, zh_corpus_sentences(F.col("_t")), None, ["row_id", "generator", "is_ai"])
    return out.select(
        "row_id", "sent_idx", "text", F.when(F.col("is_ai"), V.PROB_AI).otherwise(V.PROB_HUMAN).alias("prob"),
        F.lit("C-ReD-paper").alias("source"), "generator", F.lit("zh").alias("lang"), "is_ai",
    )


def read_generator_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files ``CReD_paper_<generator>.csv`` with columns text and label."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("text string, label string").csv(path)
    df = df.select("text", "label", F.col("_metadata.file_path").alias("path"))
    return generator_samples(df.withColumn("row_id", F.monotonically_increasing_id()))


def answer_samples(rows: DataFrame) -> DataFrame:
    """Question rows with arrays of answers to sentences: answers of a side are joined without separator and split."""
    def joined(c: str) -> Column:
        return F.array_join(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()), "")

    sides = F.array(
        F.struct(F.lit(True).alias("is_ai"), F.lit("chatgpt").alias("generator"), joined("chatgpt_answers").alias("_t")),
        F.struct(F.lit(False).alias("is_ai"), F.lit("human").alias("generator"), joined("human_answers").alias("_t")),
    )
    flat = rows.select("row_id", F.inline(sides))
    out = _explode_clean(flat, zh_corpus_sentences(F.col("_t")), None, ["row_id", "generator", "is_ai"])
    return out.select(
        "row_id", "sent_idx", "text", F.when(F.col("is_ai"), V.PROB_AI).otherwise(V.PROB_HUMAN).alias("prob"),
        F.lit("HC3").alias("source"), "generator", F.lit("zh").alias("lang"), "is_ai",
    )


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    schema = "chatgpt_answers array<string>, human_answers array<string>"
    return answer_samples(spark.read.schema(schema).json(path).withColumn("row_id", F.monotonically_increasing_id()))


def text_or_list(c: Column | str) -> Column:
    """A JSON value that is a string or a list of strings, as text; list items are joined by line breaks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(
        F.when(c.startswith("["), F.array_join(F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull()), "\n")),
        c,
        F.lit(""),
    )


def variant_text(v: Column | str) -> Column:
    """A VARIANT that is a string or a list, as text: the strings of a list joined by line breaks; nothing is the empty text."""
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    listed = F.array_join(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), "\n")
    return F.coalesce(listed, F.try_variant_get(v, "$", "string"), F.lit(""))


def paired_records(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """JSON lines to rows for ``paired_samples``, both text fields as VARIANT; lines that are no record are skipped."""
    rows = lines.select(*keep, parsed_json(value).alias("_v")).filter(_is_record("_v"))
    return rows.select(*keep, *[F.try_variant_get("_v", f"$.{c}", "variant").alias(c) for c in ("human_text", "machine_text")])


def paired_samples(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows ``file, line, human_text, machine_text`` (VARIANT, or text or JSON list) to sentences of both sides.

    The file-name prefix gives the text class; other files are not used. ``cap`` keeps the first sentences per file and
    side, in line order; ``None`` keeps all.
    """
    def side(c: str) -> Column:
        return variant_text(c) if isinstance(rows.schema[c].dataType, VariantType) else text_or_list(c)

    base = F.regexp_replace(R.base_name("file"), r"\.jsonl$", "")
    sides = F.array(
        F.struct(F.lit(False).alias("is_ai"), side("human_text").alias("_t")),
        F.struct(F.lit(True).alias("is_ai"), side("machine_text").alias("_t")),
    )
    flat = rows.select(base.alias("file"), "line", F.inline(sides)).withColumn("source", R.paired_source_class("file"))
    lang = F.when(has_han("_t"), "zh").when(is_latin("_t"), "en")
    flat = flat.withColumn("lang", lang).filter(F.col("source").isNotNull() & F.col("lang").isNotNull())
    split = F.when(F.col("lang") == "zh", zh_corpus_sentences(F.col("_t"))).otherwise(en_sentences(F.col("_t"), 8))
    out = _explode_clean(flat, split, F.col("lang"), ["file", "line", "is_ai", "source", "lang"])
    out = out.withColumn("generator", R.paired_generator("file"))
    if cap is not None:
        # every line has a sentence, so the first ``cap`` lines of a side suffice; running counts settle them line by line
        per_line = out.groupBy("file", "is_ai", "line").agg(F.count("*").alias("_n"))
        per_line = top_n_per_group(per_line, ["file", "is_ai"], [F.col("line")], cap, salt_by="line")
        run = Window.partitionBy("file", "is_ai").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        per_line = per_line.withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0))).filter(F.col("_off") < cap).drop("_n")
        rank = F.row_number().over(Window.partitionBy("file", "is_ai", "line").orderBy("sent_idx"))
        out = out.join(per_line, ["file", "is_ai", "line"]).withColumn("_r", F.col("_off") + rank).filter(F.col("_r") <= cap)
    return out.select(
        "file", "line", "sent_idx", "text", F.when(F.col("is_ai"), V.PROB_AI).otherwise(V.PROB_HUMAN).alias("prob"),
        "source", "generator", "lang", "is_ai",
    )


def read_paired(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Paired JSON-lines files; both text fields may be strings or lists."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    return paired_samples(paired_records(lines.withColumn("line", F.monotonically_increasing_id())), cap)


def public_samples(*pools: DataFrame) -> DataFrame:
    """Pools of samples in one table, one row per text and class: the first pool wins, then the pool's own order.

    Each pool needs ``text, prob, source, generator, lang, is_ai`` and may have ``row_id|line, sent_idx`` for its order.
    """
    out = None
    for i, p in enumerate(pools):
        line = F.col("row_id") if "row_id" in p.columns else F.col("line")
        q = p.select("text", "prob", "source", "generator", "lang", "is_ai", F.lit(i).alias("pool"),
                     line.cast("bigint").alias("line"), F.col("sent_idx").cast("bigint").alias("sent_idx"))
        out = q if out is None else out.unionByName(q)
    rest = ["prob", "source", "generator", "lang", "pool", "line", "sent_idx"]
    pick = F.min_by(F.struct(*rest), F.struct("pool", "line", "sent_idx"))
    return out.groupBy("is_ai", "text").agg(pick.alias("r")).select("text", "is_ai", "r.*")
