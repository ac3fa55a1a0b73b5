from __future__ import annotations

from pyspark.sql import functions as F

from .line_dedup import deduplicated
from .registry import query, table


@query("op9_line_dedup", sql=r"""
WITH raw AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)),
l AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, len(regexp_extract_all(line, '\S+')) AS w FROM raw WHERE regexp_matches(line, '\S')),
s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, list(line) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) AS ahead FROM l),
f AS (SELECT a.doc_id, a.i, min(b.i) - a.i + 1 AS length FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 50 AND b.upto - a.upto + a.w >= 50 GROUP BY a.doc_id, a.i),
g AS (SELECT b.doc_id, max(a.i) AS i, b.i - max(a.i) + 1 AS length FROM s a JOIN s b ON b.doc_id = a.doc_id AND a.i BETWEEN b.i - 50 AND b.i AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.i),
r AS (SELECT x.doc_id, x.i, x.length, list_slice(s.ahead, 1, x.length) AS run FROM (SELECT * FROM f UNION SELECT * FROM g) x JOIN s ON s.doc_id = x.doc_id AND s.i = x.i),
later AS (SELECT doc_id, i, length FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM r) WHERE k > 1),
marked AS (SELECT DISTINCT doc_id, unnest(range(i, i + length)) AS i FROM later),
isl AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
cut AS (SELECT doc_id, min(n) AS a, max(n) AS b, count(*) AS c FROM isl JOIN l USING (doc_id, i) GROUP BY doc_id, island),
gone AS (SELECT DISTINCT raw.doc_id, raw.n FROM raw JOIN cut ON cut.doc_id = raw.doc_id AND raw.n BETWEEN a AND b),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM raw ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(c) AS removed FROM cut GROUP BY doc_id) c USING (doc_id)
""")
def op9_line_dedup(spark, d):
    out = deduplicated(table(spark, d, "documents"), removed="n_removed")
    return out.select("doc_id", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
