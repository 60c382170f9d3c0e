"""Indexes that grow: each micro-batch adds its rows once, also when it is run again after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lsh import PREDICT, signatures
from ..operators.sentiment import word_stats


def add_batches(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """build(batch) of each micro-batch, written to its own folder under path and put in place of an unfinished
    earlier try. once: what is there now, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def add_signatures(reviews: DataFrame, path: str, checkpoint: str, hashes: int = PREDICT[0]) -> StreamingQuery:
    """Adds the reviews of a stream to an index for operators.lsh.predict."""
    return add_batches(reviews, lambda b: signatures(b, "review_id", hashes), path, checkpoint)


def add_word_stats(reviews: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the words of a stream to partial statistics, which merged_word_stats() sums up."""
    return add_batches(reviews, word_stats, path, checkpoint)


def merged_word_stats(spark: SparkSession, path: str) -> DataFrame:
    merged = spark.read.parquet(path).groupBy("word").agg(F.sum("score").alias("score"), F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
    return merged.withColumn("avg", F.col("score") / F.col("cnt"))
