"""The table of queries, and the views that queries and SQL share.

Rated texts are made of `documents`: the source is the title, and a rating from 0 to 5 follows from doc_id and
n_chars, so that 0 is a rating to be dropped and the classes are of unequal size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, STOPWORDS, WORD
from ..sources.reviews import as_reviews, balance, cached, make_splits, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its DuckDB SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = ((F.col("doc_id") * 7 + F.col("n_chars")) % 6).cast("double")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("title"), "text", "lang", rating.alias("rating"))


def kept(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], DataFrame], **params) -> DataFrame:
    """build()'s table, written once for each application, folder and set of parameters: the plans that start from
    it stay short, and lost executors lose nothing of it."""
    return cached(spark, f"{shared_dir(spark)}/lexiloom", {"app": spark.sparkContext.applicationId, "from": sf_dir, "what": what} | params, build)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "reviews", lambda: as_reviews(balance(raw_reviews(spark, sf_dir))))


def split_reviews(spark: SparkSession, sf_dir: str, domain: str | None = None) -> DataFrame:
    """All reviews, or those of domain A (English) or B (other languages), with their split."""
    rows = reviews(spark, sf_dir)
    if domain:
        rows = rows.where(F.col("lang") == "en" if domain == "A" else F.col("lang") != "en")
    return kept(spark, sf_dir, "split", lambda: make_splits(rows), domain=domain)


def splits(spark: SparkSession, sf_dir: str, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    marked = split_reviews(spark, sf_dir, domain)
    return marked.where("split = 'train'"), marked.where("split = 'test'")


def six(x: str | Column) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def six_sql(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


RAW = """raw AS (SELECT doc_id AS pos, source AS title, text, lang, CAST((doc_id * 7 + n_chars) % 6 AS DOUBLE) AS rating FROM documents)"""
REVIEWS = f"""{RAW},
valid AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY pos) AS rn FROM raw WHERE rating BETWEEN 1 AND 5),
cap AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM valid GROUP BY rating)),
balanced AS (SELECT pos, title, text, lang, rating FROM valid, cap WHERE rn <= m),
reviews AS (SELECT pos AS review_id, concat(coalesce(title, ''), ': ', coalesce(text, '')) AS text, rating, lang FROM balanced)"""


def split_sql(name: str = "split", where: str = "true") -> str:
    return f"""{name} AS (SELECT review_id, text, rating, lang,
  CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(review_id AS VARCHAR), ':42')), review_id) AS rn, count(*) OVER () AS n FROM reviews WHERE {where}))"""


SPLIT = f"{REVIEWS},\n{split_sql()}"


def t1(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{WORD}'), lambda w: NOT list_contains({quoted(STOPWORDS)}, w))"


def t2(text: str) -> str:
    return f"list_filter({t1(text)}, lambda w: length(w) > 1 AND regexp_full_match(w, '\\p{{L}}+'))"


def t3_clean(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_{SPACE}]', '', 'g')"


def t4(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{SPACE}]+')"


def placed(source: str, tokens: str, columns: str) -> str:
    """SELECT of columns, place (0 onwards) and word."""
    return f"SELECT {columns}, generate_subscripts(ws, 1) - 1 AS place, unnest(ws) AS word FROM (SELECT {columns}, {tokens} AS ws FROM {source})"
