import json
import shutil

import pytest
from pyspark.sql import functions as F

from textprov.sources.tables import stream_table
from textprov.streaming import ingest as ST
from textprov.streaming import retrain as RT
from textprov.streaming.known import KnownTexts


def hashes(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n int").select(F.md5(F.col("n").cast("string")).alias("text_hash"), "n")


def held(spark, known):
    return sorted(r.n for r in spark.read.schema("n int").parquet(known.target).collect())


@pytest.mark.parametrize("bits", [1 << 20, 1])
def test_known_texts_whatever_the_filter_says(spark, tmp_path, bits):
    """With a filter of one block that knows half of everything, results are the same: false positives cost a lookup only."""
    known = KnownTexts(spark, str(tmp_path / "t"), bits=bits, hashes=5 if bits > 1 else 1)
    known.append(hashes(spark, *range(40)))
    known.append(hashes(spark, *range(30, 60)))
    known.append(hashes(spark, *range(30, 60)))
    known.append(hashes(spark))
    assert held(spark, known) == list(range(60))


def test_filter_finds_all_and_little_else(spark, tmp_path):
    known = KnownTexts(spark, str(tmp_path / "t"))
    known.add(hashes(spark, *range(2000)))
    known.add(hashes(spark, *range(2000, 2500)))
    names = [r[0] for r in hashes(spark, *range(100)).select(known.prefix("text_hash")).distinct().collect()]
    assert len(names) == 16
    assert known.maybe(hashes(spark, *range(2500)), names).count() == 2500
    assert known.maybe(hashes(spark, *range(10_000, 14_000)), names).count() < 40


def test_a_batch_reads_only_its_partitions(spark, tmp_path):
    known = KnownTexts(spark, str(tmp_path / "t"), digits=2)
    known.append(hashes(spark, *range(40)))
    one = hashes(spark, 7)
    name = one.select(known.prefix("text_hash")).first()[0]
    plan = known.stored([name])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and name in plan and len(known.stored([name]).inputFiles()) >= 1
    files = {f.split("prefix=")[1][:3] for f in known.filters([name]).inputFiles()}
    read = known.stored([name]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("prefix=")[1][:3] for r in read} == {name} and name in files
    assert known.unknown(one).count() == 0 and known.unknown(hashes(spark, 4711)).count() == 1


def test_stop_between_filter_and_table(spark, tmp_path):
    """The filter knows the batch, the table does not: the batch comes again and is appended."""
    known = KnownTexts(spark, str(tmp_path / "t"))
    known.append(hashes(spark, 1, 2))
    known.add(hashes(spark, 3, 4))
    known.append(hashes(spark, 2, 3, 4))
    assert held(spark, known) == [1, 2, 3, 4]


def add(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def test_retrain_counter_goes_on_after_a_stop(spark, tmp_path):
    """Due once for a burst, after the settling time; late and timeless rows count; the next count starts from none."""
    def run():
        with RT.timed_state(spark):
            s = spark.readStream.schema("label string, at long").json(str(tmp_path / "in")).withColumn("t", F.timestamp_seconds("at"))
            w = RT.due_rows(s, "t", threshold=4, settle=10).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            q = w.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.model, r.n_new) for r in spark.read.schema(RT.DUE_SCHEMA).parquet(str(tmp_path / "out")).collect())

    row = lambda label, at, n=1: [{"label": label, "at": at}] * n
    add(tmp_path / "in", "a", row("x", 1000, 3) + row("y", 1000, 4) + row(None, 1001, 2))
    assert run() == []
    add(tmp_path / "in", "b", row("x", 1005) + row("y", 900) + row(None, None, 2))  # y settles, late and timeless rows count
    assert run() == []
    add(tmp_path / "in", "c", row("z", 5000) + row("x", 5000))
    assert run() == [("none", 4), ("x", 5), ("y", 5)]
    add(tmp_path / "in", "d", row("x", 9000, 3))
    assert run() == [("none", 4), ("x", 5), ("y", 5)]  # three since the last training
    from textprov.streaming.retrain import PROVIDER
    assert "RocksDB" not in (spark.conf.get(PROVIDER, "") or "")


def test_arrivals_within_the_watermark(spark, tmp_path):
    """A copy within the delay is dropped, one after its state is gone comes through, and a row behind the watermark is late."""
    def run():
        s = spark.readStream.schema("text string, at long").json(str(tmp_path / "in")).withColumn("t", F.timestamp_seconds("at"))
        w = ST.dedup_arrivals(s, "t", "100 seconds").select("text", "at").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        w.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.text, r.at) for r in spark.read.schema("text string, at long").parquet(str(tmp_path / "out")).collect())

    add(tmp_path / "in", "a", [{"text": "a", "at": 1000}, {"text": "a", "at": 1000}, {"text": "b", "at": 1050}])
    assert run() == [("a", 1000), ("b", 1050)]
    add(tmp_path / "in", "b", [{"text": "a", "at": 1060}, {"text": "c", "at": 2000}, {"text": "d", "at": 900}])
    assert run() == [("a", 1000), ("b", 1050), ("c", 2000)]
    add(tmp_path / "in", "c", [{"text": "a", "at": 2010}, {"text": "c", "at": 2050}])
    assert run() == [("a", 1000), ("a", 2010), ("b", 1050), ("c", 2000)]


@pytest.mark.parametrize("folder", [True, False])
def test_stream_of_a_table_of_one_or_many_files(spark, tmp_path, folder):
    rows = spark.range(30)
    rows.repartition(3).write.parquet(str(tmp_path / "many"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    target = tmp_path / "d" / "pages.parquet"
    target.parent.mkdir()
    source = tmp_path / "many" if folder else next((tmp_path / "one").glob("part-*"))
    (shutil.copytree if folder else shutil.copy)(source, target)
    (shutil.copytree if folder else shutil.copy)(source, tmp_path / "d" / "pages.parquet2")
    out = str(tmp_path / "out")
    q = stream_table(spark, str(tmp_path / "d"), "pages").writeStream.format("parquet").option("path", out)
    q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))
