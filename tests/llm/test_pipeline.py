import corpus_pipeline

from .conftest import SF


def test_pipeline_stages(spark, documents):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "sentencepiece encoding":
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
    assert all(b <= a for a, b in zip(kept, kept[1:])) and len(kept[0]) > 150 and len(kept[-1]) > 100
    assert len(kept[2]) < len(kept[1]) and kept[-1] == kept[-2]
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.n_tokens for r in docs.collect()}


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
