"""MinHash neighbours and near-duplicates; inner-product search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knn as K
from ..operators import lsh as L
from .registry import kept, query, six, six_sql, split_reviews, t1, table
from .wordwise import TRAIN_TEST

def _shingled(key: str) -> str:
    """SELECT of key and s, once each: three copies of the characters side by side, two of them moved on."""
    return f"""SELECT DISTINCT {key}, a || b || c AS s FROM (SELECT {key}, unnest(cs) AS a, unnest(cs[2:]) AS b, unnest(cs[3:]) AS c
  FROM (SELECT {key}, string_split(j, '') AS cs FROM joined)) WHERE c IS NOT NULL"""


def signature_sql(source: str, key: str, hashes: int, text: str = "text") -> str:
    """CTE sigs(key, sig): of the rows with a shingle. Every different shingle is hashed once."""
    a, b = L.coefficients(hashes)
    pairs = ", ".join(f"({i}, {x}::HUGEINT, {y}::HUGEINT)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return f"""joined AS (SELECT {key}, array_to_string({t1(text)}, '_') AS j FROM {source}),
shingled AS ({_shingled(key)}),
family(h, a, b) AS (VALUES {pairs}),
hashed AS (SELECT s, list(((a * x) % 18446744073709551616::HUGEINT + b) % 18446744073709551616::HUGEINT % {L.PRIME}::HUGEINT ORDER BY h) AS hs
  FROM (SELECT s, ('0x' || substr(md5(s), 17, 16))::UBIGINT::HUGEINT AS x FROM (SELECT DISTINCT s FROM shingled)), family GROUP BY s),
minima AS (SELECT {key}, i, min(v)::BIGINT AS v FROM (SELECT {key}, generate_subscripts(hs, 1) AS i, unnest(hs) AS v FROM shingled JOIN hashed USING (s)) GROUP BY {key}, i),
sigs AS (SELECT {key}, list(v ORDER BY i) AS sig FROM minima GROUP BY {key})"""


def band_sql(source: str, out: str, columns: str, n_hashes: int, n_bands: int) -> str:
    r = n_hashes // n_bands
    return f"{out} AS (SELECT {columns}, b, array_to_string(sig[b * {r} + 1 : b * {r} + {r}], ',') AS band_key FROM {source}, range({n_bands}) r(b))"


def share_sql(a: str, b: str, n: int) -> str:
    return f"(len(list_filter(list_zip({a}, {b}), lambda p: p[1] = p[2])) / CAST({n} AS DOUBLE))"


_JOINED = f"WITH joined AS (SELECT doc_id, array_to_string({t1('text')}, '_') AS j FROM documents)"


@query(f"{_JOINED} SELECT doc_id, s AS shingle FROM ({_shingled('doc_id')})")
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.shingles(F.col("text"))).alias("shingle"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sigs = kept(spark, sf_dir, "signatures", lambda: L.signatures(docs, "doc_id", L.NEAR[0]).drop("text"), hashes=L.NEAR[0])
    return sigs, kept(spark, sf_dir, "classes", lambda: L.classes(sigs, "doc_id"), hashes=L.NEAR[0])


_SIGS = f"WITH {signature_sql('documents', 'doc_id', L.NEAR[0])}"
_CLASSES = f"{_SIGS}, groups AS (SELECT sig, min(doc_id) AS rep, count(*) AS n FROM sigs GROUP BY sig), {band_sql('groups', 'banded', 'rep', *L.NEAR)}"
_PAIRS = f"""{_CLASSES}, cands AS (SELECT DISTINCT a.rep AS src, b.rep AS dst FROM banded a JOIN banded b USING (b, band_key) WHERE a.rep < b.rep),
pairs AS (SELECT * FROM (SELECT src, dst, {share_sql('x.sig', 'y.sig', L.NEAR[0])} AS similarity, x.n AS n_src, y.n AS n_dst
  FROM cands JOIN groups x ON x.rep = src JOIN groups y ON y.rep = dst) WHERE similarity > 0.6)"""


@query(f"{_SIGS} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sigs UNION ALL SELECT doc_id, array_to_string(list_transform(range(100), lambda i: 0), ',') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sigs)")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[0].select("doc_id", F.concat_ws(",", F.col("sig").cast("array<string>")).alias("sig"))


@query(f"{_CLASSES} SELECT rep, CAST(b AS INTEGER) AS band, band_key FROM banded")
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bands(_near(spark, sf_dir)[1], *L.NEAR).select("rep", "band", "band_key")


@query(f"{_CLASSES}, cands AS (SELECT DISTINCT a.rep AS src, b.rep AS dst FROM banded a JOIN banded b USING (b, band_key) WHERE a.rep < b.rep) SELECT count(*) AS n_pairs, CAST(sum(src) AS BIGINT) AS sum_src, CAST(sum(dst) AS BIGINT) AS sum_dst FROM cands")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate pairs of near_dup_pairs before their similarities, as a count and two sums."""
    return L.candidate_sums(_near(spark, sf_dir)[1])


@query(f"{_PAIRS} SELECT src, dst, {six_sql('similarity')} AS similarity, n_src, n_dst FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal signatures; near_dup_members has who is in a class."""
    return L.near_duplicates(_near(spark, sf_dir)[1]).withColumn("similarity", six("similarity"))


@query(f"{_CLASSES} SELECT doc_id, rep, n FROM sigs JOIN groups USING (sig)")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs, groups = _near(spark, sf_dir)
    return sigs.where("has_shingles").select("doc_id", "sig_id").join(groups.select("sig_id", "rep", "n"), "sig_id").select("doc_id", "rep", "n")


@query(f"""{_PAIRS}, linked AS (SELECT rep, sum(d) AS d FROM (SELECT src AS rep, n_dst AS d FROM pairs UNION ALL SELECT dst, n_src FROM pairs) GROUP BY rep)
SELECT doc_id, rep, CAST(n - 1 + coalesce(d, 0) AS BIGINT) AS degree FROM sigs JOIN groups USING (sig) LEFT JOIN linked USING (rep) WHERE n - 1 + coalesce(d, 0) > 0""")
def near_dup_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs, groups = _near(spark, sf_dir)
    return L.linked_degrees(L.linked_members(groups), groups, sigs, "doc_id")


@query(f"""{_PAIRS}, nodes AS (SELECT node FROM (SELECT src AS node FROM pairs UNION SELECT dst FROM pairs) ORDER BY node LIMIT 1000)
SELECT src, dst, {six_sql('similarity')} AS similarity FROM pairs WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)""")
def near_dup_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample that the network drawing shows: the first 1,000 linked nodes."""
    return L.first_links(_near(spark, sf_dir)[1], 1000).select("src", "dst", six("similarity").alias("similarity"))


@query(f"""{_PAIRS}, weighted AS (SELECT similarity, n_src * n_dst AS w FROM pairs UNION ALL SELECT CAST(1.0 AS DOUBLE), n * (n - 1) // 2 FROM groups WHERE n > 1),
ends AS (SELECT CAST(0.6 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi),
counts AS (SELECT least(floor((similarity - lo) / (hi - lo) * 30), 29) AS bin, sum(w) AS n FROM weighted, ends WHERE similarity BETWEEN lo AND hi GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, {six_sql('lo + k * ((hi - lo) / 30)')} AS lo, {six_sql('lo + (k + 1) * ((hi - lo) / 30)')} AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM range(30) r(k), ends LEFT JOIN counts ON k = bin""")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _near(spark, sf_dir)[1]
    return L.similarity_histogram(L.link_counts(groups), groups).select("bin", six("lo").alias("lo"), six("hi").alias("hi"), "n")


def vote_sql(base: str) -> str:
    """CTE votes over the rows of `split` (review_id, text, rating, split) that base defines."""
    return f"""WITH {base}, {signature_sql('split', 'review_id', L.PREDICT[0])},
labelled AS (SELECT review_id, sig, rating, split FROM sigs JOIN split USING (review_id)),
{band_sql('labelled', 'banded', 'review_id, split', *L.PREDICT)},
cands AS (SELECT DISTINCT q.review_id AS q, i.review_id AS i FROM banded q JOIN banded i USING (b, band_key) WHERE q.split = 'test' AND i.split = 'train'),
scored AS (SELECT q, i, y.rating AS label, {share_sql('x.sig', 'y.sig', L.PREDICT[0])} AS sim FROM cands JOIN labelled x ON x.review_id = q JOIN labelled y ON y.review_id = i),
best AS (SELECT q, sim, label FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, label DESC, i) AS rn FROM scored) WHERE rn <= 5),
votes AS (SELECT q AS review_id, count(*) AS n_votes, CASE WHEN sum(sim) > 0 THEN sum(sim * label) / sum(sim) ELSE avg(label) END AS vote FROM best GROUP BY q)"""


_VOTE = f"""{vote_sql(TRAIN_TEST)}
SELECT review_id, rating, {six_sql('coalesce(vote, 3.0)')} AS prediction, coalesce(n_votes, 0) AS n_votes FROM test LEFT JOIN votes USING (review_id)"""


def review_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_reviews(spark, sf_dir).select("review_id", "text", "rating", "split")
    return kept(spark, sf_dir, "signatures", lambda: L.signatures(rows, "review_id", L.PREDICT[0]).drop("text"), hashes=L.PREDICT[0], of="reviews")


@query(_VOTE)
def lsh_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = review_signatures(spark, sf_dir)
    return L.predict(sigs.where("split = 'train'"), sigs.where("split = 'test'")).withColumn("prediction", six("prediction"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated query set: ids divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where(F.col("vec_id") % 20 == 0)


_SIMS = """sims AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label AS label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 12) AS sim
  FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM sims)"""


@query(f"WITH {_SIMS} SELECT query_id, item_id, {six_sql('sim')} AS sim, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def ip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search(*vectors(spark, sf_dir)).withColumn("sim", six("sim"))


@query(f"WITH {_SIMS} SELECT query_id, item_id, {six_sql('sim')} AS sim, CAST(rank AS INTEGER) AS rank FROM ranked")
def ip_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search(*vectors(spark, sf_dir), k=None).withColumn("sim", six("sim"))


@query(f"""WITH {_SIMS}, votes AS (SELECT query_id, count(*) AS n_votes, CASE WHEN sum(greatest(sim, 0)) > 0 THEN sum(greatest(sim, 0) * label) / sum(greatest(sim, 0)) ELSE avg(label) END AS vote FROM ranked WHERE rank <= 5 GROUP BY query_id)
SELECT vec_id, CAST(label AS DOUBLE) AS rating, {six_sql('coalesce(vote, 3.0)')} AS prediction, coalesce(n_votes, 0) AS n_votes FROM embeddings LEFT JOIN votes ON query_id = vec_id WHERE vec_id % 20 = 0""")
def ip_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.predict(*vectors(spark, sf_dir)).withColumn("prediction", six("prediction"))
