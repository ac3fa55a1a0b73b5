import duckdb
import pytest

from textprov.plans import catalogue
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "src1_json_lines", "src4_paired_samples", "txt6_zh_sentences", "txt7_zh_corpus_sentences", "txt8_en_sentences", "txt13_body", "txt15_contaminated",
    "fea1_template_hits", "fea20_perplexity", "sco6_fusion", "cal2_gate", "win2_island", "win6_inline_segments", "win7_merged_runs",
    "agg1_report", "agg4_rank_auc", "joi4_best_match", "joi7_containment", "sam2_stratified_cap", "sam4_balance", "lab1_guarded_labels",
    "swp1_cost_sweep", "set1_dedup", "str4_stream_counts",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    status, n, _, _, note = compare(spark, con, SF, name, catalogue.QUERIES[name], catalogue.SQL[name])
    assert status == "ok" and n > 0, note


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_detection_plan_has_no_shuffle_of_its_own(spark):
    from textprov.plans.detect import detect
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = detect(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
