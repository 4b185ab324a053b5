"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the threads. The
index is built once into a temporary folder, as the engine would keep it; ``build_index`` is that
time, the searches run warm over the stored index (one warm-up, then the median of three).
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from lexiquarry import queries as E  # noqa: E402
from lexiquarry.operators import index as I  # noqa: E402
from lexiquarry.plans import search as Q  # noqa: E402

SEARCHES = {"term": "from", "and": "of AND from", "or": "with OR were", "not": "the -of", "phrase": '"of the"', "grouped": '(from OR "of the") the -nicht'}
DIRECT = ("atom_counts", "term_dictionary", "search_phrase_not", "reconcile_plan", "best_snippet_line")


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out, folder = {}, tempfile.mkdtemp(prefix="lexiquarry-bench-")
    try:

        def build() -> None:
            src = E.source(spark, d).repartition(int(cpus))  # one small file is one split
            I.doc_table(src, "doc_id", "text").write.parquet(f"{folder}/docs")
            I.stored_layout(I.postings(src, "doc_id", "text"), 16).write.partitionBy("bucket").parquet(f"{folder}/postings")

        out["build_index"] = timed(build)
        docs, postings = spark.read.parquet(f"{folder}/docs").cache(), spark.read.parquet(f"{folder}/postings")
        for name, query in SEARCHES.items():
            run = lambda q=query: Q.search(postings, docs, q).hits.collect()
            run()
            out[f"search_{name}"] = statistics.median(timed(run) for _ in range(3))
        for name in DIRECT:
            out[name] = timed(lambda n=name: E.QUERIES[n](spark, d).write.format("noop").mode("overwrite").save())
        try:
            from lexiquarry.llm.queries import QUERIES as corpus
        except ImportError:
            corpus = {}
        for name, f in corpus.items():
            out[name] = timed(lambda g=f: g(spark, d).write.format("noop").mode("overwrite").save())
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    total = round(sum(out.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": out, "sf": d.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
