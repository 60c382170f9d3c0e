"""Rated texts: JSON-lines scan, balanced downsample, text column, exact seeded split, dummy rows, caches."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.scores import HIGHEST, LOWEST, stars, valid
from .order import BUCKETS, rank_by_hash, rank_by_position

#: The keys that are kept of each JSON object.
SCHEMA = StructType([StructField("rating", DoubleType()), StructField("title", StringType()), StructField("text", StringType())])
#: Shares of training and validation rows, and the seed of the split.
TRAIN, VAL, SEED = 0.8, 0.1, 42
#: Fixed value: rows of the dummy source.
DUMMY_ROWS = 300


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """rating, title, text of JSON lines, beside the columns of `lines` but `value`. Blank lines and lines that are
    no JSON object are dropped; absent keys are null."""
    # inside brackets, so that anything after the object makes the line invalid
    whole = F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), ArrayType(SCHEMA))
    parsed = lines.where(F.trim(value) != "").withColumn("_r", F.when(F.size(whole) == 1, whole[0]))
    rest = [c for c in lines.columns if c != value]
    return parsed.where("_r is not null").select(*rest, "_r.rating", "_r.title", "_r.text")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """pos, rating, title, text of a JSON-lines file. pos grows with the place in the files read."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return parse_lines(lines)


def write_jsonl(df: DataFrame, path: str) -> None:
    """The three kept keys as JSON lines, UTF-8; null values leave their key out."""
    df.select("rating", "title", "text").write.mode("overwrite").json(path)


def balance(df: DataFrame, position: str = "pos") -> DataFrame:
    """As many rows of each rating as the rarest rating that occurs has: the first ones by position.

    Ratings count as whole stars (truncated); others than 1 to 5 and nulls go first. No rows give no rows.
    """
    kept = df.where(valid(F.col("rating"))).withColumn("stars", stars(F.col("rating")))
    ranked = rank_by_position(kept, ["stars"], position, "_rank")
    least = kept.groupBy("stars").count().agg(F.min("count")).first()[0]
    return ranked.where(F.col("_rank") <= F.lit(least or 0)).select(*df.columns)


def balance_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """stars 1 to 5 with the number of rows before and after balance(); 0 where there are none."""

    def counts(df: DataFrame, out: str) -> DataFrame:
        return df.where(valid(F.col("rating"))).groupBy(stars(F.col("rating")).alias("stars")).agg(F.count(F.lit(1)).alias(out))

    scale = before.sparkSession.range(LOWEST, HIGHEST + 1).select(F.col("id").cast("int").alias("stars"))
    out = scale.join(counts(before, "n_before"), "stars", "left").join(counts(after, "n_after"), "stars", "left")
    return out.na.fill(0, ["n_before", "n_after"])


def review_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def as_reviews(df: DataFrame, position: str = "pos") -> DataFrame:
    """review_id, text ("title: text"), rating (0 where absent), and the other columns of df."""
    rest = [c for c in df.columns if c not in (position, "title", "text", "rating")]
    rating = F.coalesce(F.col("rating").cast("double"), F.lit(0.0))
    return df.select(F.col(position).alias("review_id"), review_text(F.col("title"), F.col("text")).alias("text"), rating.alias("rating"), *rest)


def make_splits(df: DataFrame, key: str = "review_id", train: float = TRAIN, val: float = VAL, seed: int = SEED) -> DataFrame:
    """df with split = train, val or test: exact sizes floor(n * share), the rest test, by a seeded hash of key.

    The order doesn't depend on how df is partitioned."""
    ranked = rank_by_hash(df, key, str(seed), "_rank")
    n_train, n_val = F.floor(F.col("_rank_of") * F.lit(train)), F.floor(F.col("_rank_of") * F.lit(val))
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.select(*df.columns, split.alias("split"))


def first_rows(df: DataFrame, n: int, position: str = "review_id") -> DataFrame:
    """The first n rows by an integer position. Positions are counted in buckets first, so that the one task that orders
    rows is sent little more than n of them, however many tasks read the table."""
    lo, hi = df.agg(F.min(position), F.max(position)).first()
    if lo is None:
        return df.orderBy(position).limit(n)
    wide = -(-(hi - lo + 1) // BUCKETS)
    bucket = F.floor((F.col(position) - F.lit(lo)) / F.lit(wide))
    counts = df.where(F.col(position).isNotNull()).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # BUCKETS rows at most
    seen, last = 0, hi
    for r in counts:
        seen += r["n"]
        if seen >= n:
            last = lo + (r["b"] + 1) * wide - 1
            break
    return df.where((F.col(position) <= F.lit(min(last, hi))) | F.col(position).isNull()).orderBy(position).limit(n)


def row_at(df: DataFrame, position: int, key: str = "review_id") -> DataFrame:
    """The row at a position; the filter reaches the scan."""
    return df.where(F.col(key) == position)


def dummy_reviews(spark: SparkSession, rows: int = DUMMY_ROWS) -> DataFrame:
    """Stand-in rows for a missing file."""
    return spark.range(rows).select(
        F.col("id").alias("review_id"), F.concat(F.lit("Test review text "), F.col("id").cast("string")).alias("text"),
        (F.col("id") % 5 + 1).cast("double").alias("rating"),
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of a JSON-lines path, or the dummy rows where there is nothing at the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return dummy_reviews(spark)
    return as_reviews(read_jsonl(spark, path))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for written tables. Where it names none: the warehouse, which executors share,
    or in local mode a temporary folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lexiloom"
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lexiloom-core-"))
    return f"file://{_OWN[0]}"


def cached(spark: SparkSession, root: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s table under root, keyed by all its parameters: read where it was finished before, else written."""
    key = hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
