"""The report of every predictor, within and across domains, and predictors over encoded texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate as E
from ..operators import kmeans as C
from ..operators import knn as K
from ..operators import lsh as L
from ..operators import pairs as P
from . import nearest, training
from .registry import ORACLE, REVIEWS, kept, query, reviews, six, six_sql, split_reviews, split_sql
from .wordwise import DEAD

_SQUARE = "(prediction - rating) * (prediction - rating)"


def report_sql(predicted: str) -> str:
    """Report of a SELECT of domain, rating and prediction."""
    return f"""WITH p AS MATERIALIZED ({predicted}),
cells AS (SELECT domain, CAST(rating AS INTEGER) AS truth, CAST(round_even(round(prediction, 9), 0) AS INTEGER) AS predicted, count(*) AS n FROM p GROUP BY ALL),
axes AS (SELECT domain, truth AS predicted FROM cells UNION SELECT domain, predicted FROM cells),
grid AS (SELECT domain, t.truth, a.predicted, coalesce(n, 0) AS n FROM (SELECT DISTINCT domain, truth FROM cells) t JOIN axes a USING (domain) LEFT JOIN cells c USING (domain, truth, predicted))
SELECT domain, 'overall' AS part, CAST(NULL AS INTEGER) AS truth, CAST(NULL AS INTEGER) AS predicted, {six_sql(f'avg({DEAD})')} AS value, count(*) AS n FROM p GROUP BY domain
UNION ALL SELECT domain, 'score', CAST(rating AS INTEGER), NULL, {six_sql(f'avg({_SQUARE})')}, count(*) FROM p GROUP BY domain, rating
UNION ALL SELECT domain, 'confusion', truth, predicted, {six_sql('CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY domain, truth)')}, n FROM grid"""


def _report(spark: SparkSession, sf_dir: str, name: str, predict: Callable[[], DataFrame], domain: str = "all") -> DataFrame:
    """Report of predictions that are made once, as its parts read them several times."""
    rows = kept(spark, sf_dir, "predictions", lambda: predict().select("rating", "prediction"), of=name, domain=domain)
    return E.report(rows, domain).withColumn("value", six("value"))


def _across(spark: SparkSession, sf_dir: str, name: str, predict: Callable[[str], DataFrame]) -> DataFrame:
    """Reports on the test rows of domains A and B."""
    a, b = (_report(spark, sf_dir, name, lambda d=d: predict(d), d) for d in ("A", "B"))
    return a.unionAll(b)


def _all(name: str) -> str:
    return report_sql(f"SELECT 'all' AS domain, rating, prediction FROM ({ORACLE[name]})")


@query(_all("baseline_predict"))
def eval_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordwise import baseline_predict

    return _report(spark, sf_dir, "baseline", lambda: baseline_predict(spark, sf_dir))


@query(_all("lsh_predict"))
def eval_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "lsh", lambda: nearest.lsh_predict(spark, sf_dir))


@query(_all("ip_predict"))
def eval_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "ip", lambda: nearest.ip_predict(spark, sf_dir))


@query(_all("kmeans_predict"))
def eval_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "kmeans", lambda: training.kmeans_predict(spark, sf_dir))


@query()
def eval_tfidf_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "ridge", lambda: training.tfidf_ridge_predict(spark, sf_dir))


@query()
def eval_tfidf_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "logistic", lambda: training.tfidf_logistic_predict(spark, sf_dir))


_DOMAINS = f"""{REVIEWS}, {split_sql("split_a", "lang = 'en'")}, {split_sql("split_b", "lang <> 'en'")},
split AS (SELECT *, 'A' AS domain FROM split_a WHERE split <> 'val' UNION ALL SELECT *, 'B' AS domain FROM split_b WHERE split = 'test'),
test AS (SELECT * FROM split WHERE split = 'test')"""


@query(report_sql(f"{nearest.vote_sql(_DOMAINS)} SELECT domain, rating, {six_sql('coalesce(vote, 3.0)')} AS prediction FROM test LEFT JOIN votes USING (review_id)"))
def lsh_cross_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed on domain A's training rows, reported on the test rows of A and of B."""
    sigs = nearest.review_signatures(spark, sf_dir).drop("split")

    def part(domain: str, split: str) -> DataFrame:
        return sigs.join(split_reviews(spark, sf_dir, domain).where(f"split = '{split}'").select("review_id"), "review_id")

    return _across(spark, sf_dir, "lsh", lambda d: L.predict(part("A", "train"), part(d, "test")).withColumn("prediction", six("prediction")))


def encoded(spark: SparkSession, sf_dir: str, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: review_id, rating, embedding. All reviews are encoded once, for every split."""
    codes = kept(spark, sf_dir, "encoded", lambda: P.encode_texts(reviews(spark, sf_dir)))
    rows = split_reviews(spark, sf_dir, domain).select("review_id", "rating", "split").join(codes, "review_id")
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


def _encoded_ip(spark: SparkSession, sf_dir: str, fit: str | None, test: str | None) -> DataFrame:
    index, queries = encoded(spark, sf_dir, fit)[0], encoded(spark, sf_dir, test)[1]
    return K.predict(index, queries, "review_id", "rating").withColumn("prediction", six("prediction"))


def _encoded_kmeans(spark: SparkSession, sf_dir: str, fit: str | None, test: str | None) -> DataFrame:
    """Predictions for the test rows of one domain; the clusters of `fit` are fitted once for all domains."""
    train, queries = encoded(spark, sf_dir, fit)[0], encoded(spark, sf_dir, test)[1]
    rows = kept(spark, sf_dir, "encoded_centres", lambda: C.as_table(spark, C.fit(train, key="review_id")), domain=fit)
    centres = np.array([r["center"] for r in rows.orderBy("cluster_id").collect()])
    stats = kept(spark, sf_dir, "encoded_clusters", lambda: C.cluster_stats(C.assign(train, centres, "review_id"), len(centres), "rating"), domain=fit)
    return C.predict(queries, centres, stats, key="review_id", label="rating").withColumn("prediction", six("prediction"))


@query()
def encoded_ip_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of the test reviews by the inner products of encoded texts."""
    return _encoded_ip(spark, sf_dir, None, None)


@query()
def encoded_kmeans_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of the test reviews by clusters of the encoded training texts."""
    return _encoded_kmeans(spark, sf_dir, None, None)


@query()
def encoded_ip_cross_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed on domain A's training rows, reported on the test rows of A and of B."""
    return _across(spark, sf_dir, "encoded_ip", lambda d: _encoded_ip(spark, sf_dir, "A", d))


@query()
def encoded_kmeans_cross_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of domain A's training rows, reported on the test rows of A and of B."""
    return _across(spark, sf_dir, "encoded_kmeans", lambda d: _encoded_kmeans(spark, sf_dir, "A", d))
