"""TF-IDF over word n-grams and two linear models that tell ratings from it."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Interaction
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..functions.text import alpha_words, ngrams

# N-gram sizes, least and most document frequency, features, ridge penalty, inverse logistic penalty,
# iterations.
NGRAMS, MIN_DF, MAX_DF, FEATURES, ALPHA, C, ITERATIONS = (1, 2), 2, 0.95, 10_000, 1.0, 1.0, 1000
#: Bytes of text that a task counts n-grams of.
PART = 16 << 20
#: The solver stops when an iteration betters the objective by a smaller share.
TOLERANCE = 1e-5


def with_ngrams(docs: DataFrame, sizes: tuple[int, int] = NGRAMS) -> DataFrame:
    return docs.withColumn("ngrams", ngrams(alpha_words(F.coalesce("text", F.lit(""))), *sizes))


def dealt(docs: DataFrame, sizes: tuple[int, int] = NGRAMS) -> tuple[DataFrame, int]:
    """with_ngrams() of documents dealt into parts of PART bytes of text, no fewer than the session's shuffles have, and
    the number of parts. A task has one part, however large the files are."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // PART), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return with_ngrams(docs.repartition(n, F.xxhash64(*docs.columns)), sizes), n


def doc_freq(grams: DataFrame, parts: int | None = None) -> DataFrame:
    """ngram, df: the number of documents that hold it, counted in so many parts.

    Most n-grams occur once in what a task reads, so they are sent as they are: tables of them in the tasks that read
    would be as large as the texts and save little."""
    rows = grams.select(F.explode(F.array_distinct("ngrams")).alias("ngram"))
    return (rows.repartition(parts, "ngram") if parts else rows.repartition("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(grams: DataFrame, features: int | None = FEATURES, min_df: float = MIN_DF, max_df: float = MAX_DF, parts: int | None = None) -> DataFrame:
    """ngram, df, idf, idx: the `features` most frequent n-grams by documents (ties by n-gram), numbered in order.

    Whole thresholds are counts, fractions are shares of the number of documents rounded down; both ends count.
    idf = ln((N + 1) / (df + 1)) + 1. Without `features` all n-grams within the thresholds are taken.
    """
    n = grams.agg(F.count(F.lit(1)).alias("_n"))  # one row

    def bound(x: float):
        return F.floor(F.col("_n") * F.lit(x)) if isinstance(x, float) else F.lit(x)

    kept = doc_freq(grams, parts).join(F.broadcast(n), F.lit(True)).where(F.col("df").between(bound(min_df), bound(max_df)))
    if features is not None:
        kept = kept.orderBy(F.desc("df"), "ngram").limit(features)
    idx = F.row_number().over(Window.orderBy("ngram")) - 1  # over `features` rows at most
    return kept.select("ngram", "df", (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1).alias("idf"), idx.alias("idx"))


def vectors(grams: DataFrame, vocab: DataFrame, key: str = "review_id") -> DataFrame:
    """key, idx, tf, tfidf: sparse rows; tf is the n-gram's share of all n-grams of the document, unknown ones too."""
    counts = grams.select(key, F.size("ngrams").alias("_total"), F.explode("ngrams").alias("ngram")).groupBy(key, "_total", "ngram").agg(F.count(F.lit(1)).alias("_c"))
    known = F.broadcast(vocab.select("ngram", "idx", "idf"))  # FEATURES rows at most
    tf = F.col("_c") / F.col("_total")
    return counts.join(known, "ngram").select(key, "idx", tf.alias("tf"), (tf * F.col("idf")).alias("tfidf"))


class TfidfVectorizer:
    """fit() keeps the vocabulary (bounded by `features`); transform() adds a sparse `features` column, made in
    the JVM. No vector is scaled to unit length."""

    def __init__(self, features: int = FEATURES, sizes: tuple[int, int] = NGRAMS, min_df: float = MIN_DF, max_df: float = MAX_DF):
        self.features, self.sizes, self.min_df, self.max_df, self.vocab = features, sizes, min_df, max_df, None

    def fit(self, docs: DataFrame) -> TfidfVectorizer:
        grams, parts = dealt(docs, self.sizes)
        rows = vocabulary(grams, self.features, self.min_df, self.max_df, parts).collect()
        return self.set([(r["ngram"], r["idf"]) for r in sorted(rows, key=lambda r: r["idx"])])

    def set(self, vocab: list[tuple[str, float]]) -> TfidfVectorizer:
        self.vocab = vocab
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        if self.vocab is None:
            raise ValueError("fit() the vectorizer before transform()")
        if not self.vocab:
            raise ValueError("no n-gram is frequent enough")
        grams = with_ngrams(docs, self.sizes).withColumn("_inv", F.when(F.size("ngrams") > 0, 1.0 / F.size("ngrams")).otherwise(F.lit(0.0)))
        counted = CountVectorizerModel.from_vocabulary([g for g, _ in self.vocab], "ngrams", "_counts").transform(grams)
        shares = Interaction(inputCols=["_inv", "_counts"], outputCol="_tf").transform(counted)
        weighted = ElementwiseProduct(scalingVec=Vectors.dense([i for _, i in self.vocab]), inputCol="_tf", outputCol="features")
        return weighted.transform(shares).drop("_inv", "_counts", "_tf", "ngrams")

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        return self.fit(docs).transform(docs)


class TfidfModel:
    """A fitted vectorizer with its ridge or logistic model."""

    def __init__(self, vectorizer: TfidfVectorizer, model: LinearRegressionModel | LogisticRegressionModel):
        self.vectorizer, self.model = vectorizer, model

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs with prediction between 1 and 5."""
        out = self.model.transform(self.vectorizer.transform(docs))
        raw = F.col("prediction") + (1 if isinstance(self.model, LogisticRegressionModel) else 0)
        return out.select(*docs.columns, clamp(raw).alias("prediction"))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(i, g, w) for i, (g, w) in enumerate(self.vectorizer.vocab)], "idx int, ngram string, idf double").write.mode("overwrite").parquet(f"{path}/vocab")
        self.model.write().overwrite().save(f"{path}/{'logistic' if isinstance(self.model, LogisticRegressionModel) else 'ridge'}")

    @classmethod
    def load(cls, spark, path: str, method: str) -> TfidfModel:
        rows = spark.read.parquet(f"{path}/vocab").orderBy("idx").collect()
        kind = {"ridge": LinearRegressionModel, "logistic": LogisticRegressionModel}[method]
        return cls(TfidfVectorizer(len(rows)).set([(r["ngram"], r["idf"]) for r in rows]), kind.load(f"{path}/{method}"))


def train(docs: DataFrame, method: str = "ridge", features: int = FEATURES, sizes: tuple[int, int] = NGRAMS, tol: float = TOLERANCE) -> TfidfModel:
    """Ridge regression or multinomial logistic regression (rating 1 to 5) on TF-IDF features.

    Spark divides the penalty by the number of rows and by the deviation of the label; the arguments undo that, so
    that the objective is ||y - Xw - b||^2 + ALPHA ||w||^2, or C * sum(log loss) + ||W||^2 / 2.
    """
    if method not in ("ridge", "logistic"):
        raise ValueError(f"unknown method {method!r}: ridge or logistic")
    vectorizer = TfidfVectorizer(features, sizes).fit(docs)
    data = vectorizer.transform(docs.select("text", F.col("rating").alias("label"))).persist()
    try:
        n, spread, high = data.agg(F.count(F.lit(1)), F.stddev_samp("label"), F.max("label")).first()
        if method == "ridge":
            # the normal solver (whole sums, 4096 features at most) scales by the other deviation
            model = LinearRegression(solver="l-bfgs", elasticNetParam=0.0, standardization=False, regParam=ALPHA * (spread or 0.0) / n, tol=tol, maxIter=ITERATIONS).fit(data)
        else:
            model = LogisticRegression(family="multinomial", elasticNetParam=0.0, standardization=False, regParam=1 / (C * n), tol=tol, maxIter=ITERATIONS).fit(data.withColumn("label", F.col("label") - 1))
    finally:
        data.unpersist()
    return TfidfModel(vectorizer, model)
