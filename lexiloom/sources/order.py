"""Exact ranks over whole tables without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65_536


def _ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """1-based rank of each row in its key: the rows of lower buckets, counted apart, plus the rank within its
    own bucket. Only the counts (BUCKETS a key, at most) are ordered in one place."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"), F.sum("_in").over(whole).alias("_total"),
    )
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        df.withColumn("_within", within).join(offsets, same)
        .withColumn(out, F.col("_before") + F.col("_within"))
        .withColumnRenamed("_total", f"{out}_of")
        .drop("_bucket", "_b", "_before", "_within", *[f"_k_{k}" for k in keys])
    )


def rank_by_hash(df: DataFrame, key: str, salt: str, out: str) -> DataFrame:
    """Rank in the order of md5("key:salt"), then key, and the number of rows as `<out>_of`. Buckets are the first
    16 bits of the hash, so they are of equal size whatever the keys."""
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{salt}")).cast("binary"))
    bucket = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    return _ranked(df.withColumn("_hash", h), [], bucket, ["_hash", key], out).drop("_hash")


def rank_by_position(df: DataFrame, keys: list[str], position: str, out: str) -> DataFrame:
    """Rank in the order of an integer position within each key; a hot key is split by ranges of positions."""
    lo, hi = df.agg(F.min(position), F.max(position)).first()
    wide = max(1, -(-((hi or 0) - (lo or 0) + 1) // BUCKETS))
    return _ranked(df, keys, F.floor((F.col(position) - F.lit(lo or 0)) / F.lit(wide)), [position], out)
