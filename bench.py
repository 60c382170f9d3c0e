"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line.

Every query is run once and its whole result is written to Spark's noop sink. The prepared tables (balanced reviews,
split, signatures) are made before, and counted as queries of their own."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "review_text", "split_assign", "word_sentiment", "baseline_predict", "eval_confusion", "top_words_colored", "rating_word_freq", "length_boxplot",
    "minhash_signatures", "near_dup_degree", "lsh_predict", "doc_freq", "tfidf_vectors", "tfidf_ridge_predict", "ip_predict",
    "kmeans_predict", "kmeans_fit", "embedding_pca_2d", "rating_pairs", "contrastive_loss",
]


def main() -> None:
    from lexiloom import plans

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # the JVM's start isn't timed
    took = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale.group(1)) if scale else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
