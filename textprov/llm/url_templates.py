"""URL filters: path-template trees per host, judged by smoothed labelled purity.

A path becomes a list of segments. From the top of a host's tree downward, segments with enough pages in
their branch stay as they are; all others become a wildcard (with the file extension, if they have one). With ``min_share``
a segment also needs that share of its branch, and with ``max_depth`` the segments below are one ``**``. Every node of the tree gathers the labels of its pages. Its share of good pages is
smoothed towards its parent's; a branch that does not differ from its parent by more than chance is merged with its
siblings into the parent's share. A page is rejected if the share of its template is below ``min_purity``.

All steps are aggregates and joins on node keys. Defined cases: null and empty urls, and those without ``://``, have an
empty host and path and are judged as one host; a label other than 0 and 1, of an unknown page or null does not count;
a page with several labels counts with the least. Repeated pages are judged row by row. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_DEPTH = 6
#: A segment stays literal with at least so many pages and so great a share of its branch.
MIN_PAGES, MIN_SHARE = 5, 0.02
#: Weight of the parent's share, in pages; standard errors at which a branch is not merged; least share of good pages.
PRIOR, LEAST_Z, MIN_PURITY = 10.0, 3.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of (verdict, host, path), or nulls."""
    rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in rules]
    none = F.lit(None).cast("string")
    chain = lambda values: reduce(lambda rest, fv: F.when(fv[0], fv[1]).otherwise(rest), reversed(list(zip(fits, values))), none)
    return chain([h + p for _, h, p in rules]), chain([v for v, _, _ in rules])


def templates(pages: DataFrame, max_depth: int | None = MAX_DEPTH, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Adds ``template`` (array of segments) to rows with ``page_id``, ``host`` and ``path``."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("parts", parts).withColumn("template", F.array().cast("array<string>")).withColumn("node", F.lit(""))
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for k in range(deepest if max_depth is None else min(max_depth, deepest)):
        # rows without such a segment get a key of their own, which joins nothing and lies anywhere
        rows = rows.withColumn("ended", F.size("parts") <= k).withColumn("part", F.coalesce(F.get("parts", F.lit(k)), F.concat(F.lit("/"), F.xxhash64("page_id").cast("string"))))
        counts = rows.filter("not ended").groupBy("host", "node", "part").agg(F.count(F.lit(1)).alias("n"))
        if min_share > 0:
            totals = counts.groupBy("host", "node").agg(F.sum("n").alias("all"))
            counts = counts.join(totals, ["host", "node"]).filter(F.col("n") >= min_share * F.col("all"))
        frequent = counts.filter(F.col("n") >= min_pages).select("host", "node", "part", F.lit(True).alias("literal"))
        rows = rows.join(frequent, ["host", "node", "part"], "left")
        wild = F.concat(F.lit("*"), F.regexp_extract("part", r"(\.[A-Za-z][A-Za-z0-9]{0,4})\z", 1))
        step = F.when(F.col("literal"), F.col("part")).otherwise(wild)
        grown = F.when(F.col("ended"), F.col("template")).otherwise(F.concat("template", F.array(step)))
        rows = rows.withColumn("template", grown).withColumn("node", F.array_join("template", "/")).drop("part", "literal", "ended")
        rows = written(rows, "url-segments")  # the next depth reads it twice
    if max_depth is None:
        return rows.drop("parts", "node")
    rest = F.when(F.size("parts") > max_depth, F.concat("template", F.array(F.lit("**")))).otherwise(F.col("template"))
    return rows.withColumn("template", rest).drop("parts", "node")


def judged(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "page_id", good: str = "good",
    max_depth: int | None = MAX_DEPTH, prior: float = PRIOR, least_z: float = LEAST_Z, min_purity: float = MIN_PURITY, min_share: float = MIN_SHARE,
) -> DataFrame:
    """page_id, host, path, template, purity, rejected of every page; ``labels`` has 1 for good pages and 0 for others."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = templates(rows, max_depth, min_share=min_share)
    known = labels.select(F.col(label_id).alias("page_id"), F.col(good).cast("int").alias("good")).filter("good in (0, 1) and page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    labelled = rows.join(known, "page_id", "left")
    full = F.array_join("template", "/")
    leaves = labelled.groupBy("host", "template").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    leaves = written(leaves, "url-templates")
    n, g, depth = leaves.agg(F.sum("n"), F.sum("g"), F.max(F.size("template"))).first()
    share = leaves.withColumn("p", F.lit(((g or 0) + 1) / ((n or 0) + 2)))
    for k in range((depth or 0) + 1):
        key = F.array_join(F.slice("template", 1, k), "/") if k else F.lit("")
        nodes = share.withColumn("key", key).filter(F.size("template") >= k)
        sums = nodes.groupBy("host", "key").agg(F.sum("n").alias("sn"), F.sum("g").alias("sg"), F.max("p").alias("parent"))
        error = F.sqrt(F.col("parent") * (1 - F.col("parent")) / F.col("sn"))
        differs = (F.col("sn") > 0) & (F.abs(F.col("sg") / F.nullif(F.col("sn"), F.lit(0)) - F.col("parent")) >= least_z * error)
        own = (F.col("sg") + prior * F.col("parent")) / (F.col("sn") + prior)
        sums = sums.select("host", F.col("key"), F.when(differs, own).otherwise(F.col("parent")).alias("own"))
        share = share.withColumn("key", F.when(F.size("template") >= k, key)).join(sums, ["host", "key"], "left").select("host", "template", "n", "g", F.coalesce("own", "p").alias("p"))
        share = written(share, "url-shares")
    final = share.select("host", full.alias("full"), F.col("p").alias("purity"))
    out = rows.withColumn("full", full).join(final, ["host", "full"], "left")
    return out.select("page_id", "host", "path", F.concat(F.lit("/"), "full").alias("template"), "purity", (F.col("purity") < min_purity).alias("rejected"))
