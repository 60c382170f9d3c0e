"""Descriptive tables of the reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import describe as D
from .registry import REVIEWS, placed, query, quoted, reviews, six, six_sql, t2, t3_clean, t4


def _counts(tokens: str, group: str, source: str = "reviews") -> str:
    return f"""seen AS ({placed(source, tokens, f"{group}, review_id")}),
counts AS (SELECT {group}, word, count(*) AS cnt, row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, min(review_id * 4294967296 + place)) AS rank FROM seen GROUP BY {group}, word)"""


def _cloud(text: str, stop: list[str], least: int) -> str:
    return f"list_filter({t4(t3_clean(text))}, lambda w: NOT list_contains({quoted(stop)}, w) AND length(w) >= {least})"


_STARS = f"WITH {REVIEWS}, starred AS (SELECT *, CAST(rating AS INTEGER) AS stars FROM reviews)"
_SPIRAL = [*T.STOPWORDS, *T.SPIRAL_EXTRA]
_POLAR = f"WITH {REVIEWS}, polar AS (SELECT *, CASE WHEN rating = 1 THEN 'negative' ELSE 'positive' END AS polarity FROM reviews WHERE rating IN (1, 5))"


@query(f"{_STARS}, {_counts(t2('text'), 'stars', 'starred')} SELECT stars, word, cnt, CAST(rank AS INTEGER) AS rank FROM counts WHERE rank <= 100")
def rating_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.frequencies(D.by_stars(reviews(spark, sf_dir)), T.alpha_words(F.col("text")), ["stars"], 100)


@query(f"""{_STARS}, {_counts(t2('text'), 'stars', 'starred')} SELECT stars, CAST(sum(cnt) AS BIGINT) AS n_words, count(*) AS n_unique,
CASE stars WHEN 1 THEN 'rgb(139,0,0)' WHEN 2 THEN 'rgb(255,0,0)' WHEN 3 THEN 'rgb(255,165,0)' WHEN 4 THEN 'rgb(144,238,144)' ELSE 'rgb(0,100,0)' END AS colour FROM counts GROUP BY stars""")
def rating_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.word_totals(reviews(spark, sf_dir))


@query(f"{_POLAR}, {_counts(_cloud('text', T.CLOUD_STOPWORDS + T.CONTRAST_EXTRA, 2), 'polarity', 'polar')} SELECT polarity, word, cnt, CAST(rank AS INTEGER) AS rank FROM counts WHERE rank <= 100")
def contrastive_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.cloud_words(F.col("text"), T.CLOUD_STOPWORDS + T.CONTRAST_EXTRA, 2)
    return D.frequencies(D.polarity(reviews(spark, sf_dir)), tokens, ["polarity"], 100)


@query(f"{_STARS}, {_counts(_cloud('text', T.CLOUD_STOPWORDS + T.GRID_EXTRA, 2), 'stars', 'starred')} SELECT stars, word, cnt, CAST(rank AS INTEGER) AS rank FROM counts WHERE rank <= 80")
def rating_grid_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.cloud_words(F.col("text"), T.CLOUD_STOPWORDS + T.GRID_EXTRA, 2)
    return D.frequencies(D.by_stars(reviews(spark, sf_dir)), tokens, ["stars"], 80)


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.cloud_words(F.col("text"), _SPIRAL)
    return D.cloud_scale(D.frequencies(D.by_stars(reviews(spark, sf_dir)), tokens, ["stars"], D.SPIRAL_WORDS), ["stars"])


@query(f"""{_STARS}, {_counts(_cloud('text', _SPIRAL, 3), 'stars', 'starred')}, top AS (SELECT * FROM counts WHERE rank <= 60),
ends AS (SELECT stars, min(cnt) AS lo, max(cnt) AS hi, count(*) AS n FROM top GROUP BY stars)
SELECT stars, word, cnt, CAST(rank AS INTEGER) AS rank, {six_sql("CASE WHEN hi = lo THEN 45.0 ELSE 8.0 + CAST((cnt - lo) * 37 AS DOUBLE) / (hi - lo) END")} AS fontsize,
{six_sql("CAST(1.0 AS DOUBLE) - CAST(rank - 1 AS DOUBLE) / n * 0.6")} AS color_idx FROM top JOIN ends USING (stars)""")
def wordcloud_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).select("stars", "word", "cnt", "rank", six("fontsize").alias("fontsize"), six("color_idx").alias("color_idx"))


@query()
def wordcloud_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cloud_layout(_scaled(spark, sf_dir), "stars")


@query(f"""{_STARS}, sized AS (SELECT stars, CAST(len({t4('text')}) AS DOUBLE) AS x FROM starred),
boxes AS (SELECT stars, count(*) AS n, quantile_cont(x, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(x, CAST(0.5 AS DOUBLE)) AS q2, quantile_cont(x, CAST(0.75 AS DOUBLE)) AS q3 FROM sized GROUP BY stars)
SELECT stars, n, {six_sql('q1')} AS q1, {six_sql('q2')} AS q2, {six_sql('q3')} AS q3, CAST(min(x) AS INTEGER) AS whisker_lo, CAST(max(x) AS INTEGER) AS whisker_hi
FROM boxes JOIN sized USING (stars) WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def length_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.length_boxes(reviews(spark, sf_dir)).select("stars", "n", *[six(q).alias(q) for q in ("q1", "q2", "q3")], "whisker_lo", "whisker_hi")
