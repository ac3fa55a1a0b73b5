from textprov.sources.files import merge_samples, overwrite_partitions


def rows_of(spark, path):
    return sorted(((r.text, r.pos, r.lang, r.is_ai) for r in spark.read.schema(SCHEMA).parquet(path).collect()), key=str)


SCHEMA = "text string, pos int, lang string, is_ai boolean"


def test_replay_of_the_sinks_changes_nothing(spark, tmp_path):
    """Only named partitions are replaced; a merge adds each new text of a partition once, however often it runs."""
    path = str(tmp_path / "samples")
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    overwrite_partitions(make(("a", 1, "en", True), ("b", 2, "en", False), ("c", 3, None, True)), path)
    for _ in range(2):
        overwrite_partitions(make(("d", 4, "en", False)), path)
    assert rows_of(spark, path) == sorted([("a", 1, "en", True), ("d", 4, "en", False), ("c", 3, None, True)], key=str)
    batch = make(("a", 9, "en", True), ("a", 9, "en", False), ("e", 7, "fr", True), ("e", 6, "fr", True), ("c", 8, None, True), ("f", 5, None, True), (None, 0, "en", True))
    for _ in range(3):
        merge_samples(batch, path)
    want = [("a", 1, "en", True), ("d", 4, "en", False), ("c", 3, None, True), ("a", 9, "en", False), ("e", 6, "fr", True), ("f", 5, None, True)]
    assert rows_of(spark, path) == sorted(want, key=str)
    merge_samples(batch.limit(0), path)
    assert len(rows_of(spark, path)) == 6


def test_a_merge_reads_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "samples")
    overwrite_partitions(spark.createDataFrame([("a", 1, "en", True), ("b", 2, "de", False)], SCHEMA), path)
    (tmp_path / "samples" / "lang=de" / "is_ai=false" / "part-bad.parquet").write_text("not a table", encoding="utf-8")
    merge_samples(spark.createDataFrame([("n", 3, "en", True)], SCHEMA), path)
    assert len(list((tmp_path / "samples" / "lang=en" / "is_ai=true").glob("*.parquet"))) == 2
