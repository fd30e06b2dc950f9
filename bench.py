"""Headline queries, timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ["links_extract", "text_extract", "graph_upsert_edges", "graph_remove_stale", "edges_range_scan", "bsp_broadcast_sum", "out_degree", "pagerank_converged", "search_match", "search_phrase", "search_paged", "inverted_index", "summary_budget", "highlight", "crawl_pass_counts"]


def random_graph(spark):
    """100,000 vertices with up to six random out-links each: ranked until the scores settle."""
    from pyspark.sql import functions as F

    from webloom.operators.pagerank import pagerank

    n = 100_000
    v = spark.range(n).select("id")
    out = F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(7)).cast("int")
    each = v.withColumn("k", F.explode(F.when(out > 0, F.sequence(F.lit(1), out))))
    e = each.select(F.col("id").alias("src"), F.pmod(F.xxhash64(F.lit(7), "id", "k"), F.lit(n)).alias("dst"))
    return pagerank(v, e).vertices


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from webloom.plans.queries import QUERIES

    work = {name: (lambda s, f=QUERIES[name]: f(s, DIR)) for name in HEADLINE} | {"pagerank_random_100k": random_graph}
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name, f in work.items():
        start = time.time()
        f(spark).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(DIR.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
