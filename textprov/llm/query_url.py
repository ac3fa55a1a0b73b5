from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .url_templates import judged, rule_of

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op2_url_filter")
def op2_url_filter(spark, d):
    """A page is labelled by the quality label of the document whose number ends its url.

    Every segment with enough pages is judged, at every depth. Not SQL: the template trees. Tested against a brute-force version.
    """
    pages = table(spark, d, "pages", "page_id", "url")
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})(?:[./?#]|$)', 1) as bigint)")
    labels = pages.select("page_id", number.alias("doc_id")).join(table(spark, d, "labels", "doc_id", "quality"), "doc_id").select("page_id", F.col("quality").alias("good"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES)
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged(pages, labels, max_depth=None, min_share=0.0).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
