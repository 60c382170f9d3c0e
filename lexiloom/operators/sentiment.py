"""Word sentiment: what ratings a word goes with, and ratings told from words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp, colour, sentiment
from ..functions.text import alpha_words, first_place, unplaced, words

#: A word speaks beyond this sentiment; bins of the histogram; words of the coloured cloud.
STRONG, BINS, TOP_WORDS = 0.3, 50, 100
#: Statistics of more words than this are joined by a shuffle, not broadcast.
BROADCAST_WORDS = 200_000


def occurrences(reviews: DataFrame, tokens: Column) -> DataFrame:
    """One row per token: review_id, rating, place (0 onwards), word."""
    return reviews.select("review_id", "rating", F.posexplode(tokens).alias("place", "word"))


def word_stats(reviews: DataFrame) -> DataFrame:
    """word, score (sum of the ratings of its occurrences), cnt, avg, and its first (review_id, place)."""
    seen = occurrences(reviews, alpha_words(F.col("text")))
    grouped = seen.groupBy("word").agg(
        F.sum("rating").alias("score"), F.count(F.lit(1)).alias("cnt"), first_place().alias("_at")
    )
    return grouped.select("word", "score", "cnt", unplaced(F.col("_at")).alias("first"), (F.col("score") / F.col("cnt")).alias("avg"))


def rating_stats(reviews: DataFrame) -> DataFrame:
    """One row: mean and population standard deviation of the ratings, one of each review."""
    return reviews.agg(F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"), F.count(F.lit(1)).alias("n_reviews"))


def word_sentiment(stats: DataFrame, overall: DataFrame) -> DataFrame:
    one = F.broadcast(overall.select("mean"))
    return stats.join(one, F.lit(True)).withColumn("sentiment", sentiment(F.col("avg"), F.col("mean"))).drop("mean")


def top_words(stats: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """The n most frequent words, the one seen first on ties, with their colour."""
    return stats.orderBy(F.desc("cnt"), "first").limit(n).withColumn("colour", colour(F.col("avg")))


def sized(small: DataFrame, most: int) -> DataFrame:
    """small, marked for broadcast when it has `most` rows at most; else the join shuffles (or AQE decides)."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def predict(reviews: DataFrame, sentiments: DataFrame, overall: DataFrame, strong: float = STRONG) -> DataFrame:
    """review_id, rating, prediction, n_strong, n_unknown.

    prediction: mean + std * (mean sentiment of the occurrences of known words beyond `strong`), between 1 and 5;
    the mean where there is no such occurrence. n_unknown: tokens of such a review that the statistics lack, 0 for
    the others. Every review has one row.
    """
    known = sized(sentiments.select("word", "sentiment"), BROADCAST_WORDS)
    marked = occurrences(reviews, words(F.col("text"))).join(known, "word", "left")
    speaks = F.abs("sentiment") > strong
    found = marked.groupBy("review_id").agg(
        F.avg(F.when(speaks, F.col("sentiment"))).alias("_mean"), F.count(F.when(speaks, 1)).alias("n_strong"),
        F.count(F.when(F.col("sentiment").isNull(), 1)).alias("_unknown"),
    )
    out = reviews.select("review_id", "rating").join(found, "review_id", "left").join(F.broadcast(overall), F.lit(True))
    none = F.coalesce(F.col("n_strong"), F.lit(0)) == 0
    return out.select(
        "review_id", "rating", clamp(F.col("mean") + F.coalesce(F.col("_mean") * F.col("std"), F.lit(0.0))).alias("prediction"),
        F.coalesce("n_strong", F.lit(0)).alias("n_strong"), F.when(none, F.coalesce("_unknown", F.lit(0))).otherwise(F.lit(0)).alias("n_unknown"),
    )


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None, weight: str | None = None) -> DataFrame:
    """bin, lo, hi, n: equal bins over [lo, hi] (the values' own ends where not given), the last one closed;
    values outside are left out and empty bins have 0. All values equal: half a unit to each side."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")) if lo is None else df.sparkSession.range(1).select(F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    inside = df.join(F.broadcast(ends), F.lit(True)).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    counts = inside.groupBy(place.alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    scale = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(ends), F.lit(True))
    return scale.join(counts, "bin", "left").select(
        "bin", (F.col("_lo") + F.col("bin") * step).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * step).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
