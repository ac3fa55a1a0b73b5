"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The given tables are single files of one row group each, which one task reads alone. They are laid out in as many files
as there are cores first, as a cluster's tables would be; that is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textprov.plans import catalogue
from textprov.session import local_session

HEADLINE = [
    "agg1_report", "txt6_zh_sentences", "fea1_template_hits", "fea6_document_features", "fea12_style_features", "fea20_perplexity",
    "cal2_gate", "win2_island", "agg4_rank_auc", "swp1_cost_sweep", "set1_dedup", "sam4_balance", "lab1_guarded_labels",
    "joi4_best_match", "joi7_containment", "win9_annotated_spans", "str4_window_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    laid_out = tempfile.mkdtemp(prefix="spark-")
    for name in ("documents", "pages", "events", "conversations", "labels", "benchmark", "embeddings"):
        table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        table.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{laid_out}/{name}.parquet")
    folder, given = laid_out, folder
    catalogue.QUERIES["txt8_en_sentences"](spark, folder).write.format("noop").mode("overwrite").save()  # start workers
    times = {}
    for name in HEADLINE:
        t = time.time()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(given.rstrip("/"))}))


if __name__ == "__main__":
    main()
