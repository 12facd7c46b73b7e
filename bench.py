"""Times the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each figure is the median of BENCH_RUNS (default 3) runs after
a first one that isn't counted, written to the noop sink, so that no column is pruned away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumengrist.operators import fingerprint, index, recommend  # noqa: E402
from lumengrist.plans import registry as R  # noqa: E402
from lumengrist.sources import stores  # noqa: E402
from lumengrist.sources.shared import write_shared  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def index_build(spark):
    docs = R.documents(spark, SF)
    noop(index.postings(docs, write_shared(index.sized_frequencies(docs), "bench-frequencies")))


def dictionary_build(spark):
    d = index.dictionary(index.tokens(R.documents(spark, SF)))
    noop(index.char_index(d))


def fingerprints(spark):
    docs = R.documents(spark, SF)
    noop(fingerprint.fingerprints(docs, fingerprint.top_terms(docs, index.term_frequencies(index.tokens(docs)))))


def dedup_greedy(spark):
    noop(fingerprint.greedy_keep(R.fps(spark, SF)))


def compared_share(spark):
    """Comparisons of fingerprints, of all pairs of documents; what the four 16-bit blocks compare, likewise."""
    n = R.documents(spark, SF).count()
    blocks = fingerprint.blocks(R.fps(spark, SF)).groupBy("block_no", "block_val").count()
    plain = blocks.selectExpr("sum(count * (count - 1) div 2) AS n").first()["n"]
    return {"documents": n, "six_parts": fingerprint.compared_pairs(R.fps(spark, SF)).first()["n"] / (n * (n - 1) / 2), "four_blocks": plain / (n * (n - 1) / 2)}


def search_snippets(spark):
    noop(R.flagship(spark, SF))


def recommendation(spark):
    args = R.dictionary(spark, SF), R.char_index(spark, SF), R.postings(spark, SF)
    noop(recommend.recommend(R.asked(spark), *args, stores.max_frequency(args[0])))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for query in (index_build, dictionary_build, fingerprints, dedup_greedy, search_snippets, recommendation):
        query(spark)
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            query(spark)
            took.append(time.perf_counter() - began)
        times[query.__name__] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "compared_share_of_pairs": compared_share(spark), "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
