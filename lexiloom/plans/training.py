"""TF-IDF models, clusters, projections and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams as word_ngrams
from ..functions.text import alpha_words
from ..functions.vectors import doubles
from ..operators import evaluate as E
from ..operators import kmeans as C
from ..operators import pairs as P
from ..operators import projection
from ..operators import tfidf as V
from .nearest import vectors
from .registry import REVIEWS, query, reviews, six, six_sql, splits, t2, table
from .wordwise import TRAIN_TEST


def _grams(tokens: str) -> str:
    return f"list_concat({tokens}, list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))"


_GRAMS = f"WITH {TRAIN_TEST}, tokens AS (SELECT review_id, split, {t2('text')} AS ts FROM split), grams AS (SELECT review_id, split, {_grams('ts')} AS gs FROM tokens)"
_DF = f"""{_GRAMS}, df AS (SELECT ngram, count(*) AS df FROM (SELECT unnest(list_distinct(gs)) AS ngram FROM grams WHERE split = 'train') GROUP BY ngram), total AS (SELECT count(*) AS n FROM train),
vocab AS (SELECT ngram, df, ln(CAST(n + 1 AS DOUBLE) / (df + 1)) + 1 AS idf, row_number() OVER (ORDER BY ngram) - 1 AS idx
  FROM (SELECT * FROM df, total WHERE df BETWEEN 2 AND floor(n * CAST(0.95 AS DOUBLE)) ORDER BY df DESC, ngram LIMIT 10000))"""


@query(f"{_GRAMS} SELECT review_id, len(gs) AS n_grams, md5(array_to_string(gs, ',')) AS digest FROM grams")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each review's word n-grams, in order."""
    rows = reviews(spark, sf_dir).select("review_id", word_ngrams(alpha_words(F.col("text"))).alias("g"))
    return rows.select("review_id", F.size("g").cast("bigint").alias("n_grams"), F.md5(F.array_join("g", ",").cast("binary")).alias("digest"))


def _vocabulary(train: DataFrame) -> DataFrame:
    grams, parts = V.dealt(train)
    return V.vocabulary(grams, parts=parts)


@query(f"{_DF} SELECT ngram, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.doc_freq(*V.dealt(splits(spark, sf_dir)[0]))


@query(f"{_DF} SELECT ngram, df, {six_sql('idf')} AS idf, CAST(idx AS INTEGER) AS idx FROM vocab")
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(splits(spark, sf_dir)[0]).withColumn("idf", six("idf"))


@query(f"""{_DF}, counts AS (SELECT review_id, ngram, count(*) AS c, any_value(total) AS total FROM (SELECT review_id, len(gs) AS total, unnest(gs) AS ngram FROM grams WHERE split = 'test') GROUP BY review_id, ngram)
SELECT review_id, CAST(idx AS INTEGER) AS idx, {six_sql('CAST(c AS DOUBLE) / total')} AS tf, {six_sql('CAST(c AS DOUBLE) / total * idf')} AS tfidf FROM counts JOIN vocab USING (ngram)""")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = splits(spark, sf_dir)
    out = V.vectors(V.with_ngrams(test), _vocabulary(train))
    return out.select("review_id", "idx", six("tf").alias("tf"), six("tfidf").alias("tfidf"))


def _linear(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    train, test = splits(spark, sf_dir)
    return V.train(train, method).predict(test).select("review_id", "rating", "prediction")


@query()
def tfidf_ridge_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear(spark, sf_dir, "ridge")


@query()
def tfidf_logistic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear(spark, sf_dir, "logistic")


@query()
def tfidf_cross_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge fitted on domain A, reported on the test rows of A and of B."""
    train, test_a = splits(spark, sf_dir, "A")
    model = V.train(train)
    reports = [E.overall(model.predict(t)).select(F.lit(d).alias("domain"), "mse", "n") for d, t in (("A", test_a), ("B", splits(spark, sf_dir, "B")[1]))]
    return reports[0].unionAll(reports[1])


_UNIT = "SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_ASSIGN = f"""WITH unit AS ({_UNIT}), centres AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, v AS c FROM unit ORDER BY vec_id LIMIT 50),
dists AS (SELECT vec_id, label, cluster_id, round(list_distance(v, c), 9) AS dist FROM unit, centres),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) AS rank FROM dists),
assigned AS (SELECT vec_id, label, cluster_id FROM near WHERE rank = 1),
counts AS (SELECT cluster_id, CAST(label AS DOUBLE) AS l, count(*) AS c FROM assigned GROUP BY ALL),
modes AS (SELECT cluster_id, l AS mode FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, l) AS rn FROM counts) WHERE rn = 1),
stats AS (SELECT CAST(k AS INTEGER) AS cluster_id, coalesce(n, 0) AS n, coalesce(m, 3.0) AS mean, coalesce(s, 0.0) AS std, coalesce(mode, 3.0) AS mode
  FROM range(50) r(k) LEFT JOIN (SELECT cluster_id, count(*) AS n, avg(label) AS m, stddev_pop(label) AS s FROM assigned GROUP BY cluster_id) a ON a.cluster_id = k LEFT JOIN modes ON modes.cluster_id = k)"""


def _clusters(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "embeddings")
    centres = C.first_centres(rows)
    assigned = C.assign(rows, centres)
    return rows, centres, assigned, C.cluster_stats(assigned, C.CLUSTERS)


@query(f"{_ASSIGN} SELECT vec_id, CAST(cluster_id AS INTEGER) AS cluster_id FROM assigned")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors around the first 50 vectors."""
    return _clusters(spark, sf_dir)[2].select("vec_id", "cluster_id")


@query(f"{_ASSIGN} SELECT cluster_id, n, {six_sql('mean')} AS mean, {six_sql('std')} AS std, {six_sql('mode')} AS mode FROM stats")
def kmeans_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[3].select("cluster_id", "n", six("mean").alias("mean"), six("std").alias("std"), six("mode").alias("mode"))


@query(f"""{_ASSIGN} SELECT vec_id, CAST(label AS DOUBLE) AS rating, {six_sql('sum(mode / (dist + 1e-8)) / sum(1 / (dist + 1e-8))')} AS prediction
FROM near JOIN stats USING (cluster_id) WHERE rank <= 15 AND vec_id % 20 = 0 GROUP BY vec_id, label""")
def kmeans_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centres, _, stats = _clusters(spark, sf_dir)
    return C.predict(vectors(spark, sf_dir)[1], centres, stats).withColumn("prediction", six("prediction"))


@query(f"""{_ASSIGN} SELECT cluster_id, mode, CAST(i AS INTEGER) AS i, {six_sql('1.0 + i * (CAST(4.0 AS DOUBLE) / 99)')} AS x,
{six_sql('exp(-(1.0 + i * (CAST(4.0 AS DOUBLE) / 99) - mean) * (1.0 + i * (CAST(4.0 AS DOUBLE) / 99) - mean) / (2 * std * std)) / (std * sqrt(2 * pi()))')} AS density
FROM stats, range(100) r(i) WHERE std > 0""")
def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _clusters(spark, sf_dir)[3]
    return C.spread(stats).select("cluster_id", "mode", "i", six("x").alias("x"), six("density").alias("density"))


@query()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted clusters of all vectors, with the statistics of each."""
    rows = table(spark, sf_dir, "embeddings")
    centres = C.fit(rows)
    return C.cluster_stats(C.assign(rows, centres), len(centres)).join(F.broadcast(C.as_table(spark, centres)), "cluster_id")


@query()
def embedding_pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.project(table(spark, sf_dir, "embeddings"), 2, keep=("label",))


@query()
def embedding_pca_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.project(table(spark, sf_dir, "embeddings"), 3, keep=("label",))


def _pairs_sql(source: str, key: str, rating: str) -> str:
    return f"""ordered AS (SELECT {key} AS k, {rating} AS rating, row_number() OVER (ORDER BY md5(concat(CAST({key} AS VARCHAR), ':42')), {key}) AS pos, count(*) OVER () AS n FROM {source}),
paired AS (SELECT l.k AS left_id, r.k AS right_id, l.rating AS left_rating, r.rating AS right_rating, 1 - abs(l.rating - r.rating) / (SELECT max({rating}) FROM {source}) AS similarity
  FROM ordered l JOIN ordered r ON r.pos = CAST(('0x' || substr(md5(concat(CAST(l.k AS VARCHAR), ':pair:42')), 1, 15))::UBIGINT % CAST(l.n AS UBIGINT) AS BIGINT) + 1)"""


@query(f"WITH {REVIEWS}, {_pairs_sql('reviews', 'review_id', 'rating')} SELECT left_id, right_id, left_rating, right_rating, {six_sql('similarity')} AS similarity FROM paired")
def rating_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rating_pairs(reviews(spark, sf_dir)).withColumn("similarity", six("similarity"))


@query(f"""WITH rated AS (SELECT vec_id, CAST(label AS DOUBLE) AS rating, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {_pairs_sql('rated', 'vec_id', 'rating')},
scored AS (SELECT similarity AS y, 1 / (1 + exp(-list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) / 0.07)) AS p FROM paired JOIN rated a ON a.vec_id = left_id JOIN rated b ON b.vec_id = right_id)
SELECT {six_sql('avg(-(y * ln(p + 1e-8) + (1 - y) * ln(1 - p + 1e-8)))')} AS loss, count(*) AS n FROM scored""")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss of the seeded pairs of all vectors."""
    rated = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("rating"), doubles(F.col("embedding")).alias("v"))
    a, b = (rated.select(F.col("vec_id").alias(f"{s}_id"), F.col("v").alias(f"_{s}")) for s in ("left", "right"))
    paired = P.rating_pairs(rated, "vec_id").join(a, "left_id").join(b, "right_id")
    return paired.agg(six(F.avg(P.pair_loss(F.col("_left"), F.col("_right"), F.col("similarity")))).alias("loss"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH flat AS (SELECT label, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS m, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS h FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, {six_sql('CASE WHEN sum(m) <> 0 THEN sum(h * m) / sum(m) END')} AS value FROM flat GROUP BY label, dim""")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as the tokens of one text, masked by the sign of their first place."""
    rows = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("embedding")[0] > 0).cast("int"))
    return P.mean_pooling(rows, "label", "embedding", "mask").withColumn("value", six("value"))


@query()
def encode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.encode_texts(reviews(spark, sf_dir))
