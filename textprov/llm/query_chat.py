from __future__ import annotations

from pyspark.sql import functions as F

from .chat import perspectives
from .registry import query, table


@query("op8_chat_perspectives", sql=r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS view FROM t WHERE speaker <> 'system'),
m AS (SELECT t.conv_id, view, CAST(floor(place / 1024) AS BIGINT) AS chunk, place, speaker = view AS own,
  '<|im_start|>' || CASE WHEN speaker = view THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN v ON v.conv_id IS NOT DISTINCT FROM t.conv_id)
SELECT conv_id, view AS speaker, chunk, count(*) AS n_messages, string_agg(head || body, '' ORDER BY place) AS text,
  string_agg(length(head) || ':0,' || length(body) || ':' || CAST(CAST(own AS INT) AS VARCHAR), ',' ORDER BY place) AS mask
FROM m GROUP BY conv_id, view, chunk
""")
def op8_chat_perspectives(spark, d):
    out = perspectives(table(spark, d, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["length"].cast("string"), m["trained"].cast("int").cast("string"))), ",")
    return out.select("conv_id", "speaker", "chunk", F.size("messages").cast("bigint").alias("n_messages"), "text", mask.alias("mask"))
