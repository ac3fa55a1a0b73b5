from __future__ import annotations

from pyspark.sql import functions as F

from .prefix_trie import EMPTY, Trie, end_digests, placed, rebuilt
from .registry import query, table

_TURN = "CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')"
_FED = "CASE WHEN i % 8 = 0 THEN xor(a, CAST(ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE a END"


@query("op12_prefix_trie", sql=rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256({_TURN})) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list(struct_pack(r := role, t := text) ORDER BY place) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(range(0, 8 * length(s)), lambda a, i: xor(({_FED}) >> 1, 3988292384 * (({_FED}) & 1)), 4294967295), 4294967295) % 4 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(c.turns[1:h.h], []), coalesce(h.turns[h.h + 1:], [])) AS turns FROM h LEFT JOIN c ON c.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].t, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY d, prefix
), k AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
s AS (
  SELECT top, CAST(sum(CAST(n_children = 0 AS INT)) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM (SELECT prefix[1:a] AS top, n_children, n_convs, words FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f)) GROUP BY top
)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.top = f.prefix LEFT JOIN n AS up ON f.d > 0 AND up.d = f.d - 1 AND up.prefix = f.prefix[1:f.d - 1]
""")
def op12_prefix_trie(spark, d):
    trie = Trie(*rebuilt(placed(table(spark, d, "conversations"))))
    rows = trie.nodes.join(end_digests(trie.ends), ["depth", "k0", "k1", "k2", "k3"], "left")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved_words").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
