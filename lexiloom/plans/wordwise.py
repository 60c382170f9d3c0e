"""Word sentiment, its predictions, and the report that all predictors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import sentiment as S
from .registry import REVIEWS, SPLIT, kept, placed, query, six, six_sql, split_sql, splits, t1, t2


def stats_sql(train: str) -> str:
    return f"""seen AS ({placed(train, t2("text"), "review_id, rating")}),
stats AS (SELECT word, sum(rating) AS score, count(*) AS cnt, sum(rating) / count(*) AS avg,
  min(review_id * 4294967296 + place) AS first FROM seen GROUP BY word),
overall AS (SELECT avg(rating) AS mean, stddev_pop(rating) AS std, count(*) AS n_reviews FROM {train}),
sentiments AS (SELECT stats.*, sign(avg - mean) * (avg - mean) * (avg - mean) AS sentiment FROM stats, overall)"""


def predict_sql(test: str) -> str:
    return f"""marked AS (SELECT o.review_id, s.sentiment FROM ({placed(test, t1("text"), "review_id")}) o LEFT JOIN sentiments s USING (word)),
found AS (SELECT review_id, avg(CASE WHEN abs(sentiment) > 0.3 THEN sentiment END) AS m, count(CASE WHEN abs(sentiment) > 0.3 THEN 1 END) AS n_strong,
  count(CASE WHEN sentiment IS NULL THEN 1 END) AS unknown FROM marked GROUP BY review_id),
predicted AS (SELECT t.review_id, t.rating, least(5.0, greatest(1.0, mean + coalesce(m * std, 0.0))) AS prediction, coalesce(n_strong, 0) AS n_strong,
  CASE WHEN coalesce(n_strong, 0) = 0 THEN coalesce(unknown, 0) ELSE 0 END AS n_unknown FROM {test} t LEFT JOIN found USING (review_id), overall)"""


TRAIN_TEST = f"{SPLIT}, train AS (SELECT * FROM split WHERE split = 'train'), test AS (SELECT * FROM split WHERE split = 'test')"
FITTED = f"WITH {TRAIN_TEST}, {stats_sql('train')}"
PREDICTED = f"{FITTED}, {predict_sql('test')}"
DEAD = "CASE WHEN abs(round(prediction - rating, 9)) >= 0.5 THEN round(prediction - rating, 9) * round(prediction - rating, 9) ELSE 0 END"


def fitted(spark: SparkSession, sf_dir: str, domain: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentiments and rating statistics of the training rows, and the test rows."""
    train, test = splits(spark, sf_dir, domain)
    overall = S.rating_stats(train)
    return S.word_sentiment(S.word_stats(train), overall), overall, test


def learned(spark: SparkSession, sf_dir: str, domain: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """fitted() for predictions: sentiments are made once, as they are sized and joined with every test table."""
    sentiments, overall, test = fitted(spark, sf_dir, domain)
    return kept(spark, sf_dir, "sentiments", lambda: sentiments.select("word", "sentiment"), domain=domain), overall, test


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentiments, overall, test = learned(spark, sf_dir)
    return S.predict(test, sentiments, overall)


@query(f"{FITTED} SELECT word, score, cnt, {six_sql('avg')} AS avg FROM stats")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.word_stats(splits(spark, sf_dir)[0]).select("word", "score", "cnt", six("avg").alias("avg"))


@query(f"{FITTED} SELECT {six_sql('mean')} AS mean, {six_sql('std')} AS std, n_reviews FROM overall")
def global_rating_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rating_stats(splits(spark, sf_dir)[0]).select(six("mean").alias("mean"), six("std").alias("std"), "n_reviews")


@query(f"{FITTED} SELECT word, cnt, {six_sql('avg')} AS avg, {six_sql('sentiment')} AS sentiment FROM sentiments")
def word_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[0].select("word", "cnt", six("avg").alias("avg"), six("sentiment").alias("sentiment"))


@query(f"""{FITTED} SELECT word, cnt, concat('rgb(', CAST(trunc(255 * (1 - share)) AS INTEGER), ',', CAST(trunc(255 * share) AS INTEGER), ',0)') AS colour
FROM (SELECT word, cnt, first, (least(5.0, greatest(1.0, avg)) - 1) / 4 AS share FROM stats) ORDER BY cnt DESC, first LIMIT 100""")
def top_words_colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_words(S.word_stats(splits(spark, sf_dir)[0])).select("word", "cnt", "colour")


@query(f"""{FITTED}, ends AS (SELECT min(sentiment) AS lo, max(sentiment) AS hi FROM sentiments),
counts AS (SELECT least(floor((sentiment - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM sentiments, ends GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, {six_sql('lo + b * ((hi - lo) / 50)')} AS lo, {six_sql('lo + (b + 1) * ((hi - lo) / 50)')} AS hi, coalesce(n, 0) AS n
FROM range(50) r(b), ends LEFT JOIN counts ON b = bin""")
def sentiment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(fitted(spark, sf_dir)[0], "sentiment", S.BINS).select("bin", six("lo").alias("lo"), six("hi").alias("hi"), "n")


@query(f"{PREDICTED} SELECT review_id, rating, {six_sql('prediction')} AS prediction, n_strong FROM predicted")
def baseline_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select("review_id", "rating", six("prediction").alias("prediction"), "n_strong")


@query(f"{PREDICTED} SELECT CAST(sum(n_unknown) AS BIGINT) AS n_unknown, count(CASE WHEN n_strong = 0 THEN 1 END) AS n_silent FROM predicted")
def baseline_unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).agg(F.sum("n_unknown").alias("n_unknown"), F.count(F.when(F.col("n_strong") == 0, 1)).alias("n_silent"))


@query(f"{PREDICTED} SELECT {six_sql(f'avg({DEAD})')} AS mse, count(*) AS n FROM predicted")
def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overall(predicted(spark, sf_dir)).select(six("mse").alias("mse"), "n")


@query(f"{PREDICTED} SELECT rating AS score, {six_sql('avg((prediction - rating) * (prediction - rating))')} AS mse, count(*) AS n FROM predicted GROUP BY rating")
def eval_per_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_score(predicted(spark, sf_dir)).select("score", six("mse").alias("mse"), "n")


@query(f"""{PREDICTED}, cells AS (SELECT CAST(rating AS INTEGER) AS truth, CAST(round_even(round(prediction, 9), 0) AS INTEGER) AS predicted, count(*) AS n FROM predicted GROUP BY 1, 2),
grid AS (SELECT t.truth, p.predicted, coalesce(n, 0) AS n FROM (SELECT DISTINCT truth FROM cells) t CROSS JOIN (SELECT truth AS predicted FROM cells UNION SELECT predicted FROM cells) p
  LEFT JOIN cells c ON c.truth = t.truth AND c.predicted = p.predicted)
SELECT truth, predicted, n, {six_sql('CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY truth)')} AS percent FROM grid""")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(predicted(spark, sf_dir)).select("truth", "predicted", "n", six("percent").alias("percent"))


_CROSS = f"""WITH {REVIEWS}, {split_sql("split_a", "lang = 'en'")}, {split_sql("split_b", "lang <> 'en'")},
train AS (SELECT * FROM split_a WHERE split = 'train'),
test AS (SELECT *, 'A' AS domain FROM split_a WHERE split = 'test' UNION ALL SELECT *, 'B' AS domain FROM split_b WHERE split = 'test'), {stats_sql("train")}, {predict_sql("test")}
SELECT domain, {six_sql(f"avg({DEAD})")} AS mse, count(*) AS n FROM predicted JOIN (SELECT review_id, domain FROM test) USING (review_id) GROUP BY domain"""


@query(_CROSS)
def eval_cross_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on domain A, reported on the test rows of A and of B."""
    sentiments, overall, test_a = learned(spark, sf_dir, "A")
    reports = [E.overall(S.predict(t, sentiments, overall)).select(F.lit(d).alias("domain"), six("mse").alias("mse"), "n") for d, t in (("A", test_a), ("B", splits(spark, sf_dir, "B")[1]))]
    return reports[0].unionAll(reports[1])
