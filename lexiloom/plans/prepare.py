"""Preparation: parsing, balance, split, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import reviews as R
from .registry import RAW, REVIEWS, SPLIT, query, raw_reviews, reviews, split_reviews, t1, t2, t3_clean, t4


@query("SELECT doc_id AS pos, CAST((doc_id * 7 + n_chars) % 6 AS DOUBLE) AS rating, source AS title, text FROM documents")
def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a JSON line, among blank and broken lines, and parsed again."""
    raw = raw_reviews(spark, sf_dir)
    line = F.to_json(F.struct("rating", "title", "text", F.lit("x").alias("other")))
    lines = raw.withColumn("_l", line).select("pos", F.explode(F.array(line, F.lit("  "), F.concat(line, F.lit("}")), F.concat(line, F.lit(" x")), F.expr("substr(_l, 1, length(_l) - 1)"), F.lit("no json"))).alias("value"))
    return R.parse_lines(lines)


@query(f"WITH {REVIEWS} SELECT pos, title, text, lang, rating FROM balanced")
def balance_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.balance(raw_reviews(spark, sf_dir))


@query(f"""WITH {REVIEWS} SELECT CAST(s AS INTEGER) AS stars,
(SELECT count(*) FROM valid v WHERE v.rating = s) AS n_before, (SELECT count(*) FROM balanced b WHERE b.rating = s) AS n_after FROM range(1, 6) r(s)""")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_reviews(spark, sf_dir)
    return R.balance_report(raw, R.balance(raw))


@query(f"WITH {REVIEWS} SELECT review_id, text, rating, lang FROM reviews")
def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("review_id", "text", "rating", "lang")


@query(f"WITH {SPLIT} SELECT review_id, split FROM split")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_reviews(spark, sf_dir).select("review_id", "split")


@query(f"WITH {SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_reviews(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REVIEWS} SELECT review_id, text, rating FROM reviews ORDER BY review_id LIMIT 20000")
def first_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the first 20,000 rows, which is the feature here."""
    return R.first_rows(reviews(spark, sf_dir).select("review_id", "text", "rating"), 20_000)


@query("SELECT i AS review_id, concat('Test review text ', CAST(i AS VARCHAR)) AS text, CAST(i % 5 + 1 AS DOUBLE) AS rating FROM range(300) r(i)")
def dummy_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dummy_reviews(spark)


def _joined(spark: SparkSession, sf_dir: str, tokens) -> DataFrame:
    rows = R.as_reviews(raw_reviews(spark, sf_dir))
    return rows.select("review_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


_ALL = f"{RAW}, reviews AS (SELECT pos AS review_id, concat(coalesce(title, ''), ': ', coalesce(text, '')) AS text FROM raw)"


@query(f"WITH {_ALL} SELECT review_id, coalesce(array_to_string({t1('text')}, ' '), '') AS tokens FROM reviews")
def tokens_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, T.words)


@query(f"WITH {_ALL} SELECT review_id, coalesce(array_to_string({t2('text')}, ' '), '') AS tokens FROM reviews")
def tokens_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, T.alpha_words)


@query(f"WITH {_ALL} SELECT review_id, {t3_clean('text')} AS cleaned FROM reviews")
def clean_text_t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_reviews(raw_reviews(spark, sf_dir)).select("review_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"WITH {_ALL} SELECT review_id, len({t4('text')}) AS n_words FROM reviews")
def review_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_reviews(raw_reviews(spark, sf_dir)).select("review_id", F.size(T.spaced(F.col("text"))).cast("bigint").alias("n_words"))


@query(f"WITH {_ALL} SELECT review_id, coalesce(array_to_string({t2('text')}, ' '), '') AS prepared FROM reviews")
def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_reviews(raw_reviews(spark, sf_dir)).select("review_id", T.preprocess(F.col("text")).alias("prepared"))
