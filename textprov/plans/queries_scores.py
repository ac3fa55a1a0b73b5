"""Registered queries: features, scores, calibration, verdicts, windows, document reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FE
from ..functions import fixed_values as V
from ..functions import scores as SC
from ..functions import text as T
from ..operators import calibrate as CAL
from ..operators import features as OFE
from ..operators import ngram_lm as LM
from ..operators import reports as REP
from ..operators import windows as WIN
from ..session import cut_lineage
from ..sources.tables import read_table
from . import derived as D
from . import detect as DET
from .queries_text import COLOUR_EXPR, COLOUR_LABEL_SQL
from .registry import big, query, r6

HAN = D.HAN_ROWS
NOT_HAN = r"[^\x{4e00}-\x{9fff}]"


def _ids(rows, *cols):
    return rows.select("doc_id", big("sent_idx").alias("sent_idx"), *cols)


# --- features ----------------------------------------------------------------------------------------------------

def _hits_sql(c: str, patterns, measure: str) -> str:
    if measure == "score":
        return " + ".join(f"{D.matches_sql(c, p)} * {w}::DOUBLE" for p, w, _ in patterns)
    return " + ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN 1 ELSE 0 END" for p, _, _ in patterns)


@query("fea1_template_hits", sql=f"""
SELECT doc_id, sent_idx, round({_hits_sql('sentence', V.TEMPLATES_ZH, 'score')}, 6) AS score,
       CAST({_hits_sql('sentence', V.TEMPLATES_ZH, 'kinds')} AS BIGINT) AS n_kinds FROM {HAN}
""")
def fea1_template_hits(spark, d):
    rows = D.han_rows(spark, d).withColumn("hits", FE.phrase_hits("sentence", V.TEMPLATES_ZH))
    return _ids(rows, r6(FE.hit_score("hits")).alias("score"), big(F.size("hits")).alias("n_kinds"))


# English words in place of some frequent ones, so that the English lists find something
_EN_WORDS = "replace(replace(replace(replace({c}, ' the ', ' pivotal '), ' and ', ' moreover '), ' of ', ' however '), ' to ', ' Delve into ')"


def _en_words(c):
    for old, new in ((" the ", " pivotal "), (" and ", " moreover "), (" of ", " however "), (" to ", " Delve into ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


_EN_FEATURE_ROWS = f"(SELECT doc_id, sent_idx, {_EN_WORDS.format(c='sentence')} AS s FROM {D.EN_ROWS})"
_WORD_ANY = "(?:" + "|".join(V.CONNECTIVES_EN) + ")"


def _sum_sql(c: str, words) -> str:
    return " + ".join(D.occurrences_sql(c, w) for w in words)


@query("fea2_connectives", sql=f"""
SELECT doc_id, sent_idx, round(({_sum_sql('sentence', V.CONNECTIVES_ZH)})::DOUBLE / greatest(length(sentence), 1), 6) AS density, 'zh' AS list
FROM {HAN} WHERE {D.han_count_sql('sentence')}::DOUBLE / greatest(length(sentence), 1) > 0.3
UNION ALL
SELECT doc_id, sent_idx, round({D.matches_sql('s', chr(92) + 'b' + _WORD_ANY + chr(92) + 'b')}::DOUBLE / greatest(length(s), 1), 6), 'en' FROM {_EN_FEATURE_ROWS}
""")
def fea2_connectives(spark, d):
    zh = D.han_rows(spark, d).filter(T.is_chinese("sentence"))
    en = D.en_rows(spark, d).withColumn("sentence", _en_words(F.col("sentence")))
    def out(rows, tag):
        return _ids(rows, r6(FE.connective_density("sentence")).alias("density"), F.lit(tag).alias("list"))
    return out(zh, "zh").unionByName(out(en, "en"))


@query("fea3_frequent_words", sql=f"SELECT doc_id, sent_idx, {_sum_sql('lower(s)', V.FREQUENT_WORDS_EN)} AS n FROM {_EN_FEATURE_ROWS}")
def fea3_frequent_words(spark, d):
    rows = D.en_rows(spark, d).withColumn("sentence", _en_words(F.col("sentence")))
    return _ids(rows, FE.frequent_english_words("sentence").alias("n"))


@query("fea4_length_flags", sql=f"SELECT doc_id, sent_idx, length(sentence) > 80 AS is_long, length(sentence) < 8 AS is_short FROM {HAN}")
def fea4_length_flags(spark, d):
    return _ids(D.han_rows(spark, d), FE.is_long("sentence").alias("is_long"), FE.is_short("sentence").alias("is_short"))


_CHINESE = f"{D.han_count_sql('sentence')}::DOUBLE / greatest(length(sentence), 1) > 0.3"


@query("fea5_sentence_features", sql=f"""
SELECT doc_id, sent_idx, CAST(length(sentence) AS BIGINT) AS len, {_CHINESE} AS is_chinese,
       round(CASE WHEN {_CHINESE} THEN {_hits_sql('sentence', V.TEMPLATES_ZH, 'score')} ELSE {_hits_sql('sentence', V.TEMPLATES_EN, 'score')} END, 6) AS template_score,
       round((CASE WHEN {_CHINESE} THEN {_sum_sql('sentence', V.CONNECTIVES_ZH)} ELSE {D.matches_sql('sentence', chr(92) + 'b' + _WORD_ANY + chr(92) + 'b')} END)::DOUBLE
             / greatest(length(sentence), 1), 6) AS connective_density,
       CASE WHEN {_CHINESE} THEN 0 ELSE {_sum_sql('lower(sentence)', V.FREQUENT_WORDS_EN)} END AS ai_en_words
FROM {HAN}
""")
def fea5_sentence_features(spark, d):
    rows = D.han_rows(spark, d).withColumn("f", FE.sentence_features("sentence"))
    return _ids(rows, "f.len", "f.is_chinese", r6("f.template_score").alias("template_score"),
                r6("f.connective_density").alias("connective_density"), "f.ai_en_words")


@query("fea6_document_features", sql=f"""
WITH s AS (SELECT doc_id, length(sentence) AS n, {_sum_sql('sentence', V.CONNECTIVES_ZH)} AS conn_zh, {_CHINESE} AS zh,
                  {D.matches_sql('sentence', chr(92) + 'b' + _WORD_ANY + chr(92) + 'b')} AS conn_en,
                  {_hits_sql('sentence', V.TEMPLATES_ZH, 'score')} AS t_zh, {_hits_sql('sentence', V.TEMPLATES_EN, 'score')} AS t_en FROM {HAN})
SELECT doc_id, count(*) AS n_sentences, round(avg(n), 6) AS avg_sent_len, round(stddev_pop(n), 6) AS sent_len_std,
       round(stddev_pop(n) / avg(n), 6) AS burstiness_cv, max(n) - min(n) AS sent_len_range,
       round(sum(CASE WHEN zh THEN conn_zh ELSE conn_en END)::DOUBLE / greatest(sum(n), 1), 6) AS connective_density,
       round(sum(CASE WHEN zh THEN t_zh ELSE t_en END), 6) AS template_total,
       round(avg(CASE WHEN (CASE WHEN zh THEN t_zh ELSE t_en END) > 0 THEN 1.0 ELSE 0.0 END), 6) AS templated_sent_ratio,
       round(avg(CASE WHEN n > 80 THEN 1.0 ELSE 0.0 END), 6) AS share_long, round(avg(CASE WHEN n < 8 THEN 1.0 ELSE 0.0 END), 6) AS share_short
FROM s GROUP BY doc_id
""")
def fea6_document_features(spark, d):
    out = OFE.document_features(D.han_rows(spark, d))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _style(spark, d, *cols):
    return D.han_documents(spark, d).select("doc_id", *cols)


_TOK = rf"regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{1,4}}|[a-zA-Z]+')"
_HAN_DOCS = f"(SELECT doc_id, {D.han_sql('text')} AS text FROM documents)"


@query("fea7_mattr", sql=f"""
SELECT doc_id, round(CASE WHEN n < 50 THEN len(list_distinct(t))::DOUBLE / greatest(n, 1)
  ELSE list_avg(list_transform(range(0, n - 49, 25), lambda i: len(list_distinct(t[i + 1:i + 50]))::DOUBLE / 50)) END, 6) AS mattr
FROM (SELECT doc_id, {_TOK} AS t, len({_TOK}) AS n FROM {_HAN_DOCS})
""")
def fea7_mattr(spark, d):
    return _style(spark, d, r6(FE.mattr("text")).alias("mattr"))


@query("fea8_repetition", sql=f"""
SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE 1 - len(list_distinct(t))::DOUBLE / len(t) END, 6) AS repetition
FROM (SELECT doc_id, {_TOK} AS t FROM {_HAN_DOCS})
""")
def fea8_repetition(spark, d):
    return _style(spark, d, r6(FE.repetition("text")).alias("repetition"))


_PUNCT_SQL = "regexp_replace(text, '[^，。、；：！？,.;:!?]', '', 'g')"


@query("fea9_punctuation", sql=f"""
SELECT doc_id, round(CASE WHEN text = '' THEN 0.0 ELSE length({_PUNCT_SQL})::DOUBLE / length(text) END, 6) AS punct_density FROM {_HAN_DOCS}
""")
def fea9_punctuation(spark, d):
    return _style(spark, d, r6(FE.punctuation_density("text")).alias("punct_density"))


@query("fea10_clause_variability", sql=f"""
WITH c AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[，。；、：]'), lambda s: length({D.trim_sql('s')})), lambda n: n > 0)) AS n FROM {_HAN_DOCS}),
g AS (SELECT doc_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(n) / avg(n) END AS v FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(v, 0.0), 6) AS clause_var FROM documents LEFT JOIN g USING (doc_id)
""")
def fea10_clause_variability(spark, d):
    return _style(spark, d, r6(FE.clause_variability("text")).alias("clause_var"))


@query("fea11_function_words", sql=f"""
SELECT doc_id, round(length(regexp_replace(text, '[^{V.FUNCTION_CHARS}]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS fw_density FROM {_HAN_DOCS}
""")
def fea11_function_words(spark, d):
    return _style(spark, d, r6(FE.function_word_density("text")).alias("fw_density"))


@query("fea12_style_features", sql=f"""
SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE 1 - len(list_distinct(t))::DOUBLE / len(t) END, 6) AS repetition,
  round(CASE WHEN len(t) < 50 THEN len(list_distinct(t))::DOUBLE / greatest(len(t), 1)
  ELSE list_avg(list_transform(range(0, len(t) - 49, 25), lambda i: len(list_distinct(t[i + 1:i + 50]))::DOUBLE / 50)) END, 6) AS mattr,
  round(CASE WHEN text = '' THEN 0.0 ELSE length({_PUNCT_SQL})::DOUBLE / length(text) END, 6) AS punct_density,
  round(length(regexp_replace(text, '[^{V.FUNCTION_CHARS}]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS fw_density
FROM (SELECT doc_id, text, {_TOK} AS t FROM {_HAN_DOCS})
""")
def fea12_style_features(spark, d):
    f = _style(spark, d, FE.style_features("text").alias("f"))
    return f.select("doc_id", *[r6(f"f.{c}").alias(c) for c in ("repetition", "mattr", "punct_density", "fw_density")])


@query("fea13_burstiness", sql=f"""
SELECT doc_id, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(length(sentence)) / avg(length(sentence)) END, 6) AS burstiness
FROM {D.EN_ROWS} GROUP BY doc_id
""")
def fea13_burstiness(spark, d):
    return OFE.burstiness(D.en_rows(spark, d)).select("doc_id", r6("burstiness").alias("burstiness"))


@query("fea14_stock_phrases", sql=f"""
SELECT doc_id, sent_idx, CAST({' + '.join(f"CASE WHEN contains(sentence, '{p}') THEN 1 ELSE 0 END" for p in V.STOCK_PHRASES)} AS BIGINT) AS n FROM {HAN}
""")
def fea14_stock_phrases(spark, d):
    return _ids(D.han_rows(spark, d), FE.stock_phrase_hits("sentence").alias("n"))


# --- language model ----------------------------------------------------------------------------------------------

_LM_TOK = rf"regexp_extract_all({D.drop_sql('text')}, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]')"
_WORDS_SQL = "SELECT doc_id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM {src}) WINDOW o AS (PARTITION BY doc_id ORDER BY i)"
_GRAMS_SQL = "SELECT doc_id, w || chr(1) || w2 || chr(1) || w3 AS g, w || chr(1) || w2 AS x FROM ({words}) WHERE w3 IS NOT NULL"
_LM_CTES = f"""
tok AS (SELECT doc_id, {_LM_TOK} AS t FROM (SELECT doc_id, {D.han_sql('text')} AS text FROM documents)),
grams AS MATERIALIZED ({_GRAMS_SQL.format(words=_WORDS_SQL.format(src='tok'))}),
ng AS (SELECT g, count(*) AS c FROM grams GROUP BY g),
cx AS (SELECT x, count(*) AS cn FROM grams GROUP BY x),
st AS (SELECT (SELECT count(*) FROM grams) AS total, (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM tok)) AS vocab)
"""


def _lm(spark, d):
    return LM.train(D.han_documents(spark, d))


@query("fea18_ngram_model", sql=f"WITH {_LM_CTES} SELECT md5(g) AS gram_hash, c FROM ng")
def fea18_ngram_model(spark, d):
    return _lm(spark, d).ngrams.select(F.md5("gram").alias("gram_hash"), "c")


@query("fea18_ngram_totals", sql=f"WITH {_LM_CTES} SELECT total, vocab, (SELECT count(*) FROM cx) AS n_contexts FROM st")
def fea18_ngram_totals(spark, d):
    m = _lm(spark, d)
    return m.stats.withColumn("n_contexts", m.contexts.agg(F.count("*").alias("n")).scalar())


# sentences scored by a model of the documents with an even number; odd ones bring unseen n-grams
_LM_EVEN = _LM_CTES.replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 0)", 1)
_LM_SCORED = f"""
q AS (SELECT doc_id, {_LM_TOK} AS t FROM (SELECT doc_id, {D.han_sql('text')} AS text FROM documents)),
qg AS ({_GRAMS_SQL.format(words=_WORDS_SQL.format(src='q'))}),
pr AS (SELECT doc_id, qg.g, CASE WHEN cn IS NULL THEN 1.0::DOUBLE / (total + vocab + 1) ELSE (coalesce(c, 0) + 1)::DOUBLE / (cn + vocab + 1) END AS p
       FROM qg LEFT JOIN ng ON qg.g = ng.g LEFT JOIN cx ON qg.x = cx.x, st),
pp AS (SELECT doc_id, exp(-avg(ln(greatest(p, 1e-12)))) AS perplexity FROM pr GROUP BY doc_id)
"""


def _half_model(spark, d):
    docs = D.han_documents(spark, d)
    return LM.train(docs.filter(F.col("doc_id") % 2 == 0)), docs


@query("fea19_probabilities", sql=f"""
WITH {_LM_EVEN}, {_LM_SCORED} SELECT doc_id, round(sum(p), 6) AS sum_p, round(min(p), 9) AS min_p, count(DISTINCT g) AS n_grams FROM pr GROUP BY doc_id
""")
def fea19_probabilities(spark, d):
    model, docs = _half_model(spark, d)
    p = LM.gram_probabilities(model, docs, ["doc_id"])
    return p.groupBy("doc_id").agg(r6(F.sum(F.col("n") * F.col("prob"))).alias("sum_p"), F.round(F.min("prob"), 9).alias("min_p"),
                                   F.count("*").alias("n_grams"))


@query("joi9_lm_lookup", sql=f"""
WITH {_LM_EVEN}, {_LM_SCORED}
SELECT qg.doc_id, count(*) AS n, count(*) FILTER (cn IS NULL) AS unseen FROM qg LEFT JOIN cx ON qg.x = cx.x GROUP BY qg.doc_id
""")
def joi9_lm_lookup(spark, d):
    """Occurrences per document and how many have a context the model never saw."""
    model, docs = _half_model(spark, d)
    p = LM.gram_probabilities(model, docs, ["doc_id"])
    floor = model.stats.select(F.lit(1.0) / (F.col("total") + F.col("vocab") + 1)).scalar()
    return p.groupBy("doc_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("prob") == floor, F.col("n"))), F.lit(0)).alias("unseen"))


@query("fea20_perplexity", sql=f"WITH {_LM_EVEN}, {_LM_SCORED} SELECT doc_id, round(perplexity, 4) AS perplexity FROM pp")
def fea20_perplexity(spark, d):
    model, docs = _half_model(spark, d)
    return LM.perplexity(model, docs, ["doc_id"]).select("doc_id", F.round("perplexity", 4).alias("perplexity"))


def _human_prob():
    return F.when(F.col("quality") == 1, 0.08).when(F.col("quality") == 0, 0.85)


@query("fea21_human_base", sql=f"""
WITH {_LM_EVEN}, {_LM_SCORED} SELECT round(coalesce(avg(perplexity), 20000), 4) AS base FROM pp JOIN labels USING (doc_id) WHERE quality = 1
""")
def fea21_human_base(spark, d):
    model, docs = _half_model(spark, d)
    labels = read_table(spark, d, "labels", ["doc_id", "quality"])
    pp = LM.perplexity(model, docs, ["doc_id"]).join(labels, "doc_id", "left").withColumn("prob", _human_prob())
    return LM.human_base(pp).select(F.round("base", 4).alias("base"))


@query("fea22_perplexity_score", sql=f"""
WITH {_LM_EVEN}, {_LM_SCORED}, rel AS (SELECT source, perplexity / (SELECT avg(perplexity) FROM pp) AS r FROM pp JOIN documents USING (doc_id))
SELECT source, round(greatest(0, least(1, 0.6 * avg(CASE WHEN r < 1 THEN 1.0 ELSE 0.0 END) + 0.4 * greatest(0, least(1, 1 - avg(r) / 2)))), 6) AS perplexity_score
FROM rel GROUP BY source
""")
def fea22_perplexity_score(spark, d):
    """Documents stand for sentences, sources for documents; the base is the mean perplexity."""
    model, docs = _half_model(spark, d)
    source = read_table(spark, d, "documents", ["doc_id", "source"])
    pp = cut_lineage(LM.perplexity(model, docs, ["doc_id"]))  # read twice
    base = pp.agg(F.avg("perplexity").alias("base"))
    out = LM.perplexity_score(pp.join(source, "doc_id"), base, "source")
    return out.select("source", r6("perplexity_score").alias("perplexity_score"))


# --- scores ------------------------------------------------------------------------------------------------------

_HAS_DEEP = "CASE WHEN sent_idx % 7 = 3 THEN NULL ELSE p_deep END"
_HAS_STAT = "CASE WHEN sent_idx % 11 = 5 THEN NULL ELSE p_stat END"


@query("sco6_fusion", sql=f"""
SELECT doc_id, sent_idx, round({D.fuse_sql('a', 'b')}, 6) AS fused FROM (SELECT doc_id, sent_idx, {_HAS_STAT} AS a, {_HAS_DEEP} AS b FROM {D.SCORED_ROWS})
""")
def sco6_fusion(spark, d):
    return _ids(D.scored_rows(spark, d), r6(SC.fuse(F.expr(_HAS_STAT), F.expr(_HAS_DEEP))).alias("fused"))


@query("sco7_fusion_bias", sql=f"""
SELECT doc_id, sent_idx, round({D.fuse_sql(w='w')}, 6) AS fused FROM (SELECT *, CAST(doc_id % 11 AS DOUBLE) / 10 AS w FROM {D.SCORED_ROWS})
""")
def sco7_fusion_bias(spark, d):
    return _ids(D.scored_rows(spark, d), r6(SC.fuse("p_stat", "p_deep", (F.col("doc_id") % 11).cast("double") / 10)).alias("fused"))


@query("sco8_fusion_strategies", sql=f"""
SELECT doc_id, sent_idx, round(p_stat, 6) AS stat, round((p_stat + p_deep) / 2, 6) AS equal, round(0.7 * p_stat + 0.3 * p_deep, 6) AS weighted,
       round(greatest(p_stat, p_deep), 6) AS "max", round(p_deep, 6) AS deep FROM {D.SCORED_ROWS}
""")
def sco8_fusion_strategies(spark, d):
    from ..operators.evaluate import fusion_strategies
    return _ids(D.scored_rows(spark, d), *[r6(c).alias(k) for k, c in fusion_strategies().items()])


_LANG_ROWS = f"(SELECT *, CASE WHEN lang = 'en' THEN NULL ELSE p_deep END AS deep FROM {D.SCORED_ROWS})"


@query("sco9_language_routing", sql=f"""
SELECT doc_id, sent_idx, round({D.fuse_sql('p_stat', 'deep')}, 6) AS fused FROM {_LANG_ROWS}
""")
def sco9_language_routing(spark, d):
    from ..operators.models import route_by_language
    s = F.col("sentence")
    zh = lambda df: df.withColumn("p_stat", SC.stand_in(s, 0)).withColumn("p_deep", SC.stand_in(s, 1))
    routed = route_by_language(D.en_rows(spark, d, "lang"), zh, zh, lang="lang")
    return _ids(routed, r6(SC.fuse("p_stat", "p_deep")).alias("fused"))


@query("sco5_cosine", sql="""
SELECT vec_id, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y)), 6) AS cosine
FROM (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
""")
def sco5_cosine(spark, d):
    e = read_table(spark, d, "embeddings", ["vec_id", "embedding"])
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r6(SC.cosine("embedding", "other")).alias("cosine"))


_DOC_SCORE = "sum(p * length(sentence)) / greatest(sum(length(sentence)), 1)"


@query("sco10_document_score", sql=f"SELECT doc_id, round({_DOC_SCORE}, 6) AS overall FROM {D.SCORED_ROWS} GROUP BY doc_id")
def sco10_document_score(spark, d):
    n = F.length("sentence")
    return D.scored_rows(spark, d).groupBy("doc_id").agg(
        r6(F.sum(F.col("p") * n) / F.greatest(F.sum(n), F.lit(1))).alias("overall")
    )


_MIX_SQL = f"""
WITH {_LM_EVEN}, {_LM_SCORED}, s AS (SELECT doc_id, {_DOC_SCORE} AS overall FROM {D.SCORED_ROWS} GROUP BY doc_id),
b AS (SELECT avg(perplexity) AS base FROM pp),
f AS (SELECT doc_id, 0.9 * overall + 0.1 * greatest(0, least(1, 0.6 * CASE WHEN perplexity / base < 1 THEN 1 ELSE 0 END
      + 0.4 * greatest(0, least(1, 1 - perplexity / base / 2)))) AS final FROM s JOIN pp USING (doc_id), b)
"""


def _final_mix(spark, d):
    model, docs = _half_model(spark, d)
    n = F.length("sentence")
    overall = D.scored_rows(spark, d).groupBy("doc_id").agg((F.sum(F.col("p") * n) / F.greatest(F.sum(n), F.lit(1))).alias("overall"))
    pp = cut_lineage(LM.perplexity(model, docs, ["doc_id"]))  # read twice
    ps = LM.perplexity_score(pp, pp.agg(F.avg("perplexity").alias("base")))
    return overall.join(ps, "doc_id").withColumn("final", SC.final_mix("overall", "perplexity_score"))


@query("sco11_final_mix", sql=_MIX_SQL + "SELECT doc_id, round(final, 6) AS final FROM f")
def sco11_final_mix(spark, d):
    return _final_mix(spark, d).select("doc_id", r6("final").alias("final"))


@query("ver4_graded_state", sql=_MIX_SQL + """
SELECT doc_id, CASE WHEN final >= 0.5 THEN 'high' WHEN final >= 0.35 THEN 'suspect' WHEN final >= 0.2 THEN 'weak' ELSE 'human' END AS state FROM f
""")
def ver4_graded_state(spark, d):
    return _final_mix(spark, d).select("doc_id", SC.graded_state("final").alias("state"))


# --- calibration -------------------------------------------------------------------------------------------------
# groups are sources: large ones, with positions numbered through the documents

_SKEWED = "pow(p, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0.5 END)"  # even documents lean human, odd ones lean AI
_LEANING = f"(SELECT *, {_SKEWED} AS q FROM {D.SCORED_ROWS})"


def _leaning(spark, d, *extra):
    e = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(0.5)
    return D.scored_rows(spark, d, *extra).withColumn("q", F.pow(F.col("p"), e))


_ALPHA = "least(0.35, 0.9 * abs(m - 0.5))"


@query("cal1_context", sql=f"""
SELECT doc_id, sent_idx, round({_ALPHA} * m + (1 - {_ALPHA}) * q, 6) AS p_cal FROM (SELECT *, avg(q) OVER (PARTITION BY doc_id) AS m FROM {_LEANING})
""")
def cal1_context(spark, d):
    return _ids(CAL.context_calibrate(_leaning(spark, d), score="q"), r6("p_cal").alias("p_cal"))


_GATE_ALPHA = f"least(0.45, {_ALPHA} * 0.45 / 0.35)"


@query("cal2_gate", sql=f"""
SELECT doc_id, sent_idx, m < 0.35 AS applied, round(CASE WHEN m < 0.35 AND q > m THEN {_GATE_ALPHA} * m + (1 - {_GATE_ALPHA}) * q ELSE q END, 6) AS p_cal
FROM (SELECT *, avg(q) OVER (PARTITION BY doc_id) AS m FROM {_LEANING})
""")
def cal2_gate(spark, d):
    return _ids(CAL.gate_calibrate(_leaning(spark, d), score="q"), "applied", r6("p_cal").alias("p_cal"))


# a score of two digits; an odd one in three of them is left out of the fit, so that predictions interpolate
_TWO_DIGITS = f"(SELECT doc_id, sent_idx, CAST(floor(p * 100) AS INT) AS c, floor(p * 100) / 100 AS q, label FROM {D.SCORED_ROWS})"


@query("cal3_isotonic", sql=f"""
WITH s AS (SELECT * FROM {_TWO_DIGITS}), v AS (SELECT c, q, sum(label) AS y, count(*) AS n FROM s WHERE doc_id % 5 < 3 AND c % 3 < 2 GROUP BY c, q),
run AS (SELECT c, q, sum(y) OVER w AS sy, sum(n) OVER w AS sn, sum(y) OVER w - y AS ry, sum(n) OVER w - n AS rn FROM v WINDOW w AS (ORDER BY c)),
lows AS (SELECT a.c AS a, k.c AS k, min((b.sy - a.ry)::DOUBLE / (b.sn - a.rn)) AS low FROM run a JOIN run k ON k.c >= a.c JOIN run b ON b.c >= k.c GROUP BY a.c, k.c),
fit AS (SELECT k.c, k.q, max(low) AS y FROM lows JOIN run k ON k.c = lows.k GROUP BY k.c, k.q),
pts AS (SELECT c, q, (SELECT max(c) FROM fit f WHERE f.c <= t.c) AS c0, (SELECT min(c) FROM fit f WHERE f.c >= t.c) AS c1 FROM (SELECT DISTINCT c, q FROM s) t),
m AS (SELECT pts.c, CASE WHEN c0 IS NULL THEN b.y WHEN c1 IS NULL OR a.c = b.c THEN a.y ELSE a.y + (b.y - a.y) * (pts.q - a.q) / (b.q - a.q) END AS y
  FROM pts LEFT JOIN fit a ON a.c = c0 LEFT JOIN fit b ON b.c = c1)
SELECT doc_id, sent_idx, round(m.y, 6) AS p_iso FROM s JOIN m USING (c)
""")
def cal3_isotonic(spark, d):
    """Isotonic map fitted on three fifths of the documents and two thirds of the scores, applied to all sentences."""
    rows = D.scored_rows(spark, d).withColumn("c", F.floor(F.col("p") * 100)).withColumn("q", F.floor(F.col("p") * 100) / 100)
    model = CAL.fit_isotonic(rows.filter((F.col("doc_id") % 5 < 3) & (F.col("c") % 3 < 2)), score="q")
    return _ids(CAL.isotonic_scores(rows, model, score="q"), r6("p_iso").alias("p_iso"))


@query("cal4_brier", sql=f"SELECT lang, round(avg(pow(p - label, 2)), 6) AS brier, count(*) AS n FROM {D.SCORED_ROWS} GROUP BY lang")
def cal4_brier(spark, d):
    return CAL.brier(D.scored_rows(spark, d, "lang"), by="lang").withColumn("brier", r6("brier"))


@query("cal5_reliability", sql=f"""
SELECT b AS bin_low, round(avg(p), 6) AS mean_predicted, round(avg(label), 6) AS actual_rate, count(*) AS n
FROM (SELECT *, CASE WHEN p < 0.2 THEN 0.0::DOUBLE WHEN p < 0.4 THEN 0.2::DOUBLE WHEN p < 0.6 THEN 0.4::DOUBLE WHEN p < 0.8 THEN 0.6::DOUBLE
      WHEN p < 1 THEN 0.8::DOUBLE END AS b FROM {D.SCORED_ROWS}) WHERE b IS NOT NULL GROUP BY b
""")
def cal5_reliability(spark, d):
    out = CAL.reliability(D.scored_rows(spark, d))
    return out.select("bin_low", r6("mean_predicted").alias("mean_predicted"), r6("actual_rate").alias("actual_rate"), "n")


# --- windows -----------------------------------------------------------------------------------------------------

def _window_sql(value: str) -> str:
    return f"""
w AS (SELECT doc_id, sent_idx, avg({value}) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS m,
      count(*) OVER (PARTITION BY doc_id) AS n FROM s),
r AS (SELECT doc_id, sent_idx, round(m, 12) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY round(m, 12) DESC, sent_idx) AS k
      FROM w WHERE sent_idx <= n - least(6, n)),
best AS (SELECT doc_id, CASE WHEN m > 0 THEN m ELSE 0.0 END AS best, CAST(CASE WHEN m > 0 THEN sent_idx ELSE -1 END AS BIGINT) AS start FROM r WHERE k = 1)
"""


@query("win1_densest_share", sql=f"""
WITH s AS (SELECT * FROM {D.SCORED_ROWS}), {_window_sql("CASE WHEN p >= 0.9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")}
SELECT doc_id, round(best, 6) AS best, start, n_scores FROM best JOIN (
  SELECT doc_id, count(*) FILTER (sent_idx >= start AND sent_idx < start + 6 AND start >= 0) AS n_scores FROM s JOIN best USING (doc_id) GROUP BY doc_id) USING (doc_id)
""")
def win1_densest_share(spark, d):
    rows = D.scored_rows(spark, d)
    best = WIN.densest_share(rows, limit=0.9)
    inside = WIN.window_scores(rows, best).select("doc_id", big(F.size("scores")).alias("n_scores"))
    out = best.join(inside, "doc_id", "left").withColumn("n_scores", F.coalesce("n_scores", F.lit(0).cast("bigint")))
    return out.withColumn("best", r6("best"))


@query("win2_island", sql=f"WITH s AS (SELECT * FROM {D.SCORED_ROWS}), {_window_sql('p')} SELECT doc_id, round(best, 6) AS best, start FROM best")
def win2_island(spark, d):
    return WIN.densest_mean(D.scored_rows(spark, d)).withColumn("best", r6("best"))


@query("win3_neighbourhood", sql=f"""
WITH s AS (SELECT * FROM {D.SCORED_ROWS}), {_window_sql('p')},
nb AS (SELECT doc_id, sent_idx, round(avg(p) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS neighborhood_mean FROM s)
SELECT doc_id, sent_idx, neighborhood_mean, neighborhood_mean < 0.35 AS isolated, start >= 0 AND sent_idx >= start AND sent_idx < start + 6 AS in_island
FROM nb JOIN best USING (doc_id)
""")
def win3_neighbourhood(spark, d):
    rows = D.scored_rows(spark, d)
    out = WIN.mark_islands(WIN.neighbourhoods(rows), WIN.densest_mean(rows))
    return _ids(out, "neighborhood_mean", "isolated", "in_island")


@query("win4_top_sentences", sql=f"""
SELECT doc_id, sent_idx, rank, substr(sentence, 1, 200) AS sentence, round(p, 6) AS p FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, sent_idx) AS rank FROM {D.SCORED_ROWS}) WHERE rank <= 20 AND p >= 0.5
""")
def win4_top_sentences(spark, d):
    out = WIN.top_sentences(D.scored_rows(spark, d))
    return _ids(out, big("rank").alias("rank"), "sentence", r6("p").alias("p"))


@query("win5_templated_sentences", sql=f"""
SELECT doc_id, sent_idx, substr(sentence, 1, 120) AS sentence, CAST({_hits_sql('sentence', V.TEMPLATES_ZH, 'kinds')} AS BIGINT) AS n_templates,
       {"CASE " + " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{t}'" for p, _, t in V.TEMPLATES_ZH) + " END"} AS first_template
FROM {HAN} WHERE {_hits_sql('sentence', V.TEMPLATES_ZH, 'kinds')} > 0
""")
def win5_templated_sentences(spark, d):
    docs = D.han_documents(spark, d)
    rows = docs.select("doc_id", F.posexplode(T.zh_sentences("text")).alias("sent_idx", "sentence"))
    out = rows.withColumn("templates", FE.template_names("sentence")).filter(F.size("templates") > 0)
    return _ids(out, F.substring("sentence", 1, 120).alias("sentence"), big(F.size("templates")).alias("n_templates"),
                F.get("templates", F.lit(0)).alias("first_template"))


@query("win6_inline_segments", sql=f"""
WITH s AS (SELECT doc_id, sent_idx AS seg_idx, {D.drop_sql('sentence')} AS piece, (doc_id + sent_idx) % 100 AS pct FROM {HAN}),
p AS (SELECT doc_id, seg_idx, pct, l FROM (SELECT *, list_filter(list_transform({D.stop_list_sql('piece')}, lambda x: {D.trim_sql('x')}), lambda x: length(x) > 3) AS l FROM s)),
e AS (SELECT doc_id, seg_idx, pct, i AS sent_idx, l[i + 1] AS sentence FROM (SELECT *, unnest(range(len(l))) AS i FROM p))
SELECT doc_id, seg_idx, sent_idx, sentence, round(pct::DOUBLE / 100, 4) AS prob,
       CASE WHEN pct >= 60 THEN 'high' WHEN pct >= 40 THEN 'medium' ELSE 'human' END AS label FROM e WHERE {D.han_count_sql('sentence')} > 0
""")
def win6_inline_segments(spark, d):
    """Han documents as report bodies: every sentence is followed by its mark."""
    docs = D.han_documents(spark, d).withColumn("l", T.zh_sentences("text"))
    pct = lambda i: ((F.col("doc_id") + i) % 100).cast("string")
    body = F.array_join(F.transform("l", lambda s, i: F.concat(
        s, F.lit("\n"), pct(i), F.lit("%("), F.length(T.drop_space(s)).cast("string"), F.lit(")"))), "\n")
    rows = docs.select("doc_id", F.concat(F.lit("知网 原文内容"), body).alias("text"))
    out = REP.inline_segments(rows, ["doc_id"])
    return out.select("doc_id", big("seg_idx").alias("seg_idx"), big("sent_idx").alias("sent_idx"), "sentence", "prob", "label")


_RUNS = f"(SELECT doc_id, sent_idx // 8 AS para_idx, sent_idx AS run_idx, sentence AS text, (doc_id + sent_idx // 2) AS k FROM {HAN})"


@query("win7_merged_runs", sql=f"""
WITH r AS (SELECT *, {COLOUR_LABEL_SQL} AS label FROM {_RUNS}),
c AS (SELECT *, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM r WINDOW w AS (PARTITION BY doc_id, para_idx ORDER BY run_idx)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id, para_idx ORDER BY run_idx) AS grp FROM c),
m AS (SELECT doc_id, para_idx, grp, label, string_agg(text, '' ORDER BY run_idx) AS text FROM g WHERE label <> 'skip' GROUP BY ALL)
SELECT doc_id, para_idx, CAST(grp AS BIGINT) AS grp, label, {D.trim_sql('text')} AS text FROM m WHERE length(text) > 4 AND {D.han_count_sql('text')} > 0
""")
def win7_merged_runs(spark, d):
    """Han sentences as coloured runs, eight to a paragraph, two to a colour."""
    i = F.col("sent_idx").cast("bigint")
    runs = D.han_rows(spark, d).select(
        "doc_id", F.expr("cast(sent_idx div 8 as bigint)").alias("para_idx"), i.alias("run_idx"), F.col("sentence").alias("text"),
        (F.col("doc_id") + F.expr("sent_idx div 2")).alias("k"),
    )
    runs = runs.select("*", *[F.expr(e).alias(c) for c, e in COLOUR_EXPR.items()])
    out = REP.merge_runs(runs)
    return out.select("doc_id", "para_idx", big("grp").alias("grp"), "label", "text")


@query("win7_long_paragraphs", sql=f"""
WITH r AS (SELECT *, {COLOUR_LABEL_SQL} AS label FROM (
  SELECT source, doc_id, sent_idx, sentence AS text, (doc_id // 16 + sent_idx // 64) AS k FROM {HAN})),
c AS (SELECT *, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM r WINDOW w AS (PARTITION BY source ORDER BY doc_id, sent_idx)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY source ORDER BY doc_id, sent_idx) AS grp FROM c),
m AS (SELECT source, grp, label, string_agg(text, '' ORDER BY doc_id, sent_idx) AS text FROM g WHERE label <> 'skip' GROUP BY ALL)
SELECT source, CAST(grp AS BIGINT) AS grp, label, md5({D.trim_sql('text')}) AS text_hash FROM m WHERE length(text) > 4 AND {D.han_count_sql('text')} > 0
""")
def win7_long_paragraphs(spark, d):
    """All Han sentences of a source as the runs of one paragraph, over many chunks; colours change within and between documents."""
    runs = D.han_rows(spark, d, "source").select(
        "source", (F.col("doc_id") * 1_000_000 + F.col("sent_idx")).alias("run_idx"), F.col("sentence").alias("text"),
        F.expr("doc_id div 16 + sent_idx div 64").alias("k"),
    )
    runs = runs.select("*", *[F.expr(e).alias(c) for c, e in COLOUR_EXPR.items()])
    out = REP.merge_runs(runs, ["source"], chunk=32_000_000)
    return out.select("source", big("grp").alias("grp"), "label", F.md5("text").alias("text_hash"))


# report pages: paragraphs of the pages become annotated spans with a popover
_LEVEL = "CASE page_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"
_INNER_SQL = f"""
SELECT page_id, i AS span_idx, p[i + 1] AS inner_html, CAST(page_id * 7 % 101 AS DOUBLE) AS pct, {_LEVEL} AS level FROM (
  SELECT page_id, p, unnest(range(len(p))) AS i FROM (
    SELECT page_id, regexp_extract_all({D.han_sql('html')}, '<就>([^<]*)</就>', 1) AS p FROM pages)) WHERE length(p[i + 1]) % 2 = 0
"""


def mark_pages(pages):
    """Plain paragraphs of the pages, after the letter map, as annotated spans, each in a paragraph of its own; those with an
    even number of characters have a popover."""
    lead = F.concat(F.lit('<em class="'), F.expr(_LEVEL), F.lit(' x">'))
    pop = F.concat(F.lit('</em> <div class="y aigc-detection-chance-popover">AI生成的可能性为：<i class="n">'),
                   (F.col("page_id") * 7 % 101).cast("string"), F.lit("%</i></div>"))
    marked = F.regexp_replace(D.han_text("html"), F.lit("<就>((?:[^<]{2})*)</就>"), F.concat(F.lit("<p>"), lead, F.lit("$1"), pop, F.lit("</p>")))
    marked = F.regexp_replace(marked, F.lit("<就>([^<]*)</就>"), F.concat(F.lit("<p>"), lead, F.lit("$1</em></p>")))
    return pages.select("page_id", marked.alias("html"))


def _report_pages(spark, d):
    return mark_pages(read_table(spark, d, "pages", ["page_id", "html"]))


_PLAIN = (f"replace(replace(replace(replace(replace(replace({D.trim_sql('inner_html')}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
          "'&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')")


@query("win9_annotated_spans", sql=f"""
SELECT page_id, span_idx, {_PLAIN} AS text, round(pct / 100, 4) AS prob, CASE WHEN pct >= 60 THEN 'high' WHEN pct >= 40 THEN 'medium' ELSE 'human' END AS label
FROM ({_INNER_SQL}) WHERE length({_PLAIN}) > 3 AND {D.han_count_sql(_PLAIN)} > 0
""")
def win9_annotated_spans(spark, d):
    out = REP.span_annotations(_report_pages(spark, d), ["page_id"])
    return out.select("page_id", big("span_idx").alias("span_idx"), "text", "prob", "label")


@query("win9_page_reports", sql=f"""
SELECT page_id, CAST(page_id % 90 AS DOUBLE) AS total_rate, 1000 + page_id AS words, coalesce(n, 0) AS n_spans
FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM ({_INNER_SQL}) WHERE {_PLAIN} <> '' GROUP BY page_id) USING (page_id)
""")
def win9_page_reports(spark, d):
    head = F.concat(F.lit("<p>疑似率："), (F.col("page_id") % 90).cast("string"), F.lit("% </p><p>字数：1,"),
                    F.lpad(F.col("page_id").cast("string"), 3, "0"), F.lit("</p>"))
    words = F.when(F.col("page_id") < 1000, head).otherwise(
        F.concat(F.lit("<p>疑似率："), (F.col("page_id") % 90).cast("string"), F.lit("% </p><p>字数："), (F.col("page_id") + 1000).cast("string"), F.lit("</p>")))
    pages = _report_pages(spark, d).withColumn("html", F.concat(words, "html"))
    out = REP.page_reports(pages, ["page_id"])
    return out.select("page_id", "total_rate", "words", big(F.size("sentences")).alias("n_spans"))


# --- document reports and verdicts -------------------------------------------------------------------------------

_DETECT_CTES = f"""
d AS (SELECT doc_id, source, lang, text, {D.lang_sql('text')} AS tl FROM documents),
sp AS (SELECT doc_id, source, lang, text, tl, CASE WHEN tl = 'en' THEN {D.en_list_sql('text')} ELSE {D.zh_list_sql('text')} END AS l FROM d),
s AS (SELECT doc_id, i AS sent_idx, sentence, length(sentence) AS n_ch, {D.stand_in_sql('sentence', 0)} AS p_stat,
      CASE WHEN tl = 'en' THEN NULL ELSE {D.stand_in_sql('sentence', 1)} END AS p_deep, {D.fuse_sql(D.stand_in_sql('sentence', 0), f"(CASE WHEN tl = 'en' THEN NULL ELSE {D.stand_in_sql('sentence', 1)} END)")} AS p
      FROM (SELECT doc_id, tl, i, l[i + 1] AS sentence FROM (SELECT doc_id, tl, l, unnest(range(len(l))) AS i FROM sp))),
{_window_sql('p')},
g AS (SELECT *, avg(p) OVER (PARTITION BY doc_id) AS m FROM s),
fin AS (SELECT *, CASE WHEN m < 0.35 AND p > m THEN {_GATE_ALPHA} * m + (1 - {_GATE_ALPHA}) * p ELSE p END AS f FROM g),
rep AS (SELECT doc_id, sum(f * n_ch) / greatest(sum(n_ch), 1) AS overall, avg(p_stat) AS stat_prob, count(*) AS n_sentences,
        sum(CASE WHEN f >= 0.5 THEN n_ch ELSE 0 END) AS ai_chars, count(*) FILTER (f >= 0.5) AS ai_sentence_count FROM fin GROUP BY doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, sent_idx) AS k FROM fin),
top AS (SELECT doc_id, string_agg(CAST(sent_idx AS VARCHAR) || ':' || substr(md5(substr(sentence, 1, 200)), 1, 6), ',' ORDER BY k) AS top_list
        FROM rk WHERE k <= 20 AND f >= 0.5 GROUP BY doc_id),
full_rep AS (SELECT d.doc_id, source, length(text) AS total_chars, overall, stat_prob, coalesce(n_sentences, 0) AS n_sentences, coalesce(ai_chars, 0) AS ai_chars,
        coalesce(ai_sentence_count, 0) AS ai_sentence_count, best, start, coalesce(top_list, '') AS top_list
        FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN top USING (doc_id))
"""
_STATE = f"CASE WHEN overall >= 0.5 THEN '{V.STATE_HIGH}' WHEN best >= 0.9 THEN '{V.STATE_ISLAND}' WHEN overall >= 0.2 THEN '{V.STATE_WEAK}' WHEN overall IS NOT NULL THEN '{V.STATE_HUMAN}' END"
_VERDICT = f"CASE WHEN overall * 100 < 40 THEN '{V.VERDICT_HUMAN}' WHEN overall * 100 < 60 THEN '{V.VERDICT_SUSPECT}' WHEN overall IS NOT NULL THEN '{V.VERDICT_AI}' END"


def _fused(spark, d, *extra):
    docs = D.documents(spark, d, *extra)
    return DET.fuse_documents(DET.stand_in_scorer(DET.split_documents(docs)))


@query("agg1_report", sql=f"""
WITH {_DETECT_CTES}
SELECT doc_id, CASE WHEN n_sentences = 0 THEN '{DET.NO_SENTENCES}' END AS error, round(overall, 4) AS overall_ai_prob, round(overall * 100, 1) AS ai_feature_rate,
       round(stat_prob, 4) AS stat_prob, n_sentences, total_chars, CAST(ai_chars AS BIGINT) AS ai_chars, ai_sentence_count, round(best, 6) AS island_mean,
       start AS island_start, {_STATE} AS state, {_VERDICT} AS verdict, top_list FROM full_rep
""")
def agg1_report(spark, d):
    """Detection report of every document, the top list as positions with a hash of the cut sentence."""
    out = DET.detect(D.documents(spark, d))
    top = F.array_join(F.transform("top_ai_sentences", lambda t: F.concat(
        t["sent_idx"].cast("string"), F.lit(":"), F.substring(F.md5(t["sentence"]), 1, 6))), ",")
    return out.withColumn("top_list", top).drop("top_ai_sentences", "deep_prob")


@query("agg1_top_diagnostics", sql=f"""
WITH {_DETECT_CTES},
nb AS (SELECT *, round(avg(f) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS nm FROM rk)
SELECT doc_id, sent_idx, round(f, 4) AS ai_prob, round(p_stat, 4) AS stat_prob, nm AS neighborhood_mean, nm < 0.35 AS isolated,
       start >= 0 AND start <= sent_idx AND sent_idx < start + 6 AS in_ai_island
FROM nb JOIN best USING (doc_id) WHERE k <= 20 AND f >= 0.5
""")
def agg1_top_diagnostics(spark, d):
    out = DET.top_diagnostics(DET.detect(D.documents(spark, d)), ["doc_id"])
    return _ids(out, "ai_prob", "stat_prob", "neighborhood_mean", "isolated", "in_ai_island")


@query("agg2_batch_report", sql=f"""
WITH {_DETECT_CTES}
SELECT CASE WHEN doc_id % 2 = 0 THEN 'doc-' || doc_id END AS path, CASE WHEN doc_id % 2 = 1 THEN substr(text, 1, 50) END AS text_snippet,
       CASE WHEN doc_id % 10 = 4 THEN '文件不存在' WHEN n_sentences = 0 THEN '{DET.NO_SENTENCES}' END AS error,
       CASE WHEN doc_id % 10 <> 4 THEN round(overall, 4) END AS overall_ai_prob
FROM full_rep JOIN d USING (doc_id)
""".replace("full_rep JOIN d USING (doc_id)", "(SELECT full_rep.*, d.text FROM full_rep JOIN d USING (doc_id))"))
def agg2_batch_report(spark, d):
    """Even documents come as paths, some of them unreadable; odd ones as texts."""
    docs = D.documents(spark, d)
    paths = docs.filter(F.col("doc_id") % 2 == 0).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 10 != 4, F.col("text")).alias("text")
    )
    out = DET.detect_batch(paths, docs.filter(F.col("doc_id") % 2 == 1).select("text"))
    return out.select("path", "text_snippet", "error", "overall_ai_prob")


@query("ver1_ai_sentences", sql=f"""
SELECT doc_id, count(*) FILTER (p >= 0.5) AS ai_sentence_count, count(*) AS n FROM {D.SCORED_ROWS} GROUP BY doc_id
""")
def ver1_ai_sentences(spark, d):
    return D.scored_rows(spark, d).groupBy("doc_id").agg(
        F.count_if(F.col("p") >= V.AI_SENTENCE_LIMIT).alias("ai_sentence_count"), F.count("*").alias("n")
    )


def _verdict_query(column):
    def run(spark, d):
        rows = _fused(spark, d).filter(F.size("sents") > 0)
        return rows.select("doc_id", column().alias("verdict"))
    return run


_ANY = "FROM full_rep WHERE n_sentences > 0"
query("ver2_service_state", sql=f"WITH {_DETECT_CTES} SELECT doc_id, {_STATE} AS verdict {_ANY}")(
    _verdict_query(lambda: SC.service_state("overall", "island.best")))
query("ver3_report_verdict", sql=f"WITH {_DETECT_CTES} SELECT doc_id, {_VERDICT} AS verdict {_ANY}")(
    _verdict_query(lambda: SC.report_verdict("overall")))
query("ver5_suite_verdict", sql=f"""
WITH {_DETECT_CTES} SELECT doc_id, CASE WHEN overall >= 0.5 THEN '高度疑似' WHEN best >= 0.9 THEN '含AI段' WHEN overall >= 0.35 THEN '疑似'
  WHEN overall >= 0.2 THEN '证据不足' ELSE '基本人类' END AS verdict {_ANY}
""")(_verdict_query(lambda: SC.suite_verdict("overall", "island.best")))


@query("ver6_label_classes", sql="""
SELECT event_id, CASE WHEN event_id % 6 IN (2, 3, 4) THEN 1 ELSE 0 END AS is_ai, CASE WHEN event_id % 6 IN (2, 3) THEN 1 ELSE 0 END AS by_prob FROM events
""")
def ver6_label_classes(spark, d):
    ev = read_table(spark, d, "events", ["event_id"]).withColumn("k", F.col("event_id")).withColumn("label", F.expr(COLOUR_LABEL_SQL))
    ev = ev.withColumn("prob", F.when(F.col("label") == "skip", 0.0).otherwise(
        F.when(F.col("label") == "high", 0.8).when(F.col("label") == "medium", 0.5).when(F.col("label") == "low", 0.22).otherwise(0.15)))
    return ev.select("event_id", SC.label_is_ai("label").alias("is_ai"), SC.prob_is_ai("prob").alias("by_prob"))


@query("ver7_quality_gate", sql=f"""
WITH {_DETECT_CTES} SELECT doc_id, CASE WHEN n_sentences = 0 THEN 'error' WHEN round(overall, 4) < 0.5 THEN 'pass' ELSE 'fail' END AS gate FROM full_rep
""")
def ver7_quality_gate(spark, d):
    return DET.quality_check(D.documents(spark, d), threshold=0.5).select("doc_id", "gate")


DETECT_CTES = _DETECT_CTES
fused_documents = _fused
