"""Values derived by hand, properties, and models against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import scores, text, vectors
from lexiloom.operators import describe, evaluate, kmeans, knn, lsh, pairs, projection, sentiment, tfidf
from lexiloom.sources import reviews as R
from lexiloom.sources.order import rank_by_position
from lexiloom.streaming import incremental

SF = "/root/testdata/sf0.01"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("t,want", [("Nice, nice cat!", ["nic", "ice", "ce_", "e_n", "_ni", "e_c", "_ca", "cat"]), ("ab", []), ("the and of", []), ("𝒳𝒴𝒵a", ["𝒳𝒴𝒵", "𝒴𝒵a"])])
def test_shingles(spark, t, want):
    assert one(spark, text.shingles(F.col("t")), t=t) == want


def test_tokenisers(spark):
    t = "Don't STOP, x_1 naïve 42 go! été end"
    assert one(spark, text.words(F.col("t")), t=t) == ["stop", "x_1", "naïve", "42", "go", "été", "end"]
    assert one(spark, text.alpha_words(F.col("t")), t=t) == ["stop", "naïve", "go", "été", "end"]
    assert one(spark, text.cloud_words(F.col("t"), text.STOPWORDS), t=t) == ["dont", "stop", "x_1", "naïve", "été", "end"]
    assert one(spark, F.size(text.spaced(F.col("t"))), t=t) == 8
    assert one(spark, text.ngrams(F.split("t", " ")), t="a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, text.ngrams(F.split("t", " ")), t="a") == ["a"]


def test_minhash_signature(spark):
    rows = spark.createDataFrame([("Nice, nice cat!",), ("cat nice nice",), ("ab",), (None,)], "text string")
    sigs = [r[0] for r in rows.select(lsh.signature(F.col("text"), 10)).collect()]
    assert sigs[2] == sigs[3] == [0] * 10 and all(0 < v < lsh.PRIME for v in sigs[0])
    import hashlib

    a, b = lsh.coefficients(10)
    grams = ["nic", "ice", "ce_", "e_n", "_ni", "e_c", "_ca", "cat"]
    x = [int.from_bytes(hashlib.md5(g.encode()).digest()[8:], "big") for g in grams]
    assert sigs[0] == [min((int(p) * v + int(q)) % 2**64 % lsh.PRIME for v in x) for p, q in zip(a, b)]


def _sig(spark, rows):
    df = spark.createDataFrame(rows, "review_id long, rating double, sig array<bigint>")
    return df.withColumn("sig_id", F.md5(F.concat_ws(",", F.col("sig").cast("array<string>")).cast("binary"))).withColumn("has_shingles", F.exists("sig", lambda v: v != 0))


def test_residues():
    edge = [0, 1, lsh.PRIME - 1, lsh.PRIME, lsh.PRIME + 1, 2 * lsh.PRIME, 7 * lsh.PRIME + 6, 8 * lsh.PRIME, 8 * lsh.PRIME + 7, (1 << 64) - 1]
    v = np.concatenate([np.array(edge, np.uint64), np.random.default_rng(1).integers(0, (1 << 64) - 1, 10_000, dtype=np.uint64)])
    assert (lsh.residues(v) == v % np.uint64(lsh.PRIME)).all()


def test_confusion_grid(spark):
    df = spark.createDataFrame([(1, 1.2), (1, 2.6), (2, 2.0), (2, 9.0)], "rating int, prediction double")
    got = sorted(tuple(r) for r in evaluate.confusion(df).collect())
    want = [(t, p, n, 50.0 * n) for t, p, n in [(1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 9, 0), (2, 1, 0), (2, 2, 1), (2, 3, 0), (2, 9, 1)]]
    assert got == want and evaluate.confusion(df.limit(0)).count() == 0


def test_lsh_votes(spark):
    index = _sig(spark, [(1, 5.0, [1, 2, 3, 4]), (2, 2.0, [1, 2, 9, 9]), (3, 1.0, [7, 7, 7, 7]), (4, 1.0, [1, 2, 3, 4])])
    queries = _sig(spark, [(10, 3.0, [1, 2, 3, 4]), (11, 3.0, [5, 5, 5, 5]), (12, 3.0, [0, 0, 0, 0])])
    by_k = {k: {r["review_id"]: (r["prediction"], r["n_votes"]) for r in lsh.predict(index, queries, params=(4, 2), k=k).collect()} for k in (1, 2, 3)}
    assert by_k[1][10] == (5.0, 1) and by_k[2][10] == (3.0, 2) and by_k[3][10] == ((5 + 1 + 0.5 * 2) / 2.5, 3)
    assert by_k[1][11] == by_k[1][12] == (3.0, 0)


def test_near_duplicates_count_copies(spark):
    rows = [(i, 0.0, [1, 2, 3, 4, 5]) for i in range(40)] + [(100, 0.0, [1, 2, 3, 4, 9]), (101, 0.0, [8, 8, 8, 8, 8])]
    sigs = _sig(spark, rows)
    groups = lsh.classes(sigs, "review_id")
    found = lsh.near_duplicates(groups, (5, 5))
    assert [tuple(r) for r in found.collect()] == [(0, 100, 0.8, 40, 1)]
    degree = {r["review_id"]: r["degree"] for r in lsh.degrees(found, groups, sigs, "review_id").collect()}
    assert degree == {i: 40 for i in range(40)} | {100: 40}
    assert lsh.similarity_histogram(found, groups).agg(F.sum("n")).first()[0] == 40 * 39 // 2 + 40


def test_balance_and_split(spark, tmp_path):
    rows = [(i, r, "t", "x") for i, r in enumerate([1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 4.7, 4, 4, 4, *[5] * 9, 0, 0.9, 6, None])]
    df = spark.createDataFrame([(i, None if r is None else float(r), t, x) for i, r, t, x in rows], "pos long, rating double, title string, text string")
    kept = R.balance(df)
    assert sorted(r["pos"] for r in kept.collect()) == [0, 1, 3, 4, 8, 9, 10, 11, 14, 15]
    report = {r["stars"]: (r["n_before"], r["n_after"]) for r in R.balance_report(df, kept).collect()}
    assert report == {1: (3, 2), 2: (5, 2), 3: (2, 2), 4: (4, 2), 5: (9, 2)}
    assert R.balance(df.limit(0)).count() == 0
    for n, want in ((10, (8, 1, 1)), (19, (15, 1, 3))):
        marked = R.make_splits(spark.range(n).withColumnRenamed("id", "review_id"))
        counts = {r["split"]: r["count"] for r in marked.groupBy("split").count().collect()}
        assert tuple(counts[s] for s in ("train", "val", "test")) == want
        again = R.make_splits(spark.range(n).withColumnRenamed("id", "review_id").repartition(5))
        assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, again.collect()))
    ranks = rank_by_position(spark.range(1000).withColumn("k", F.lit("x")), ["k"], "id", "r").collect()
    assert all(r["r"] == r["id"] + 1 and r["r_of"] == 1000 for r in ranks)


def test_jsonl(spark, tmp_path):
    lines = ['{"rating": 4.0, "title": "a", "text": "b", "more": [1]}', "", "   ", "{broken", '{"rating": 1}', '{"rating": 1} x', "[1]", '{"rating": 2, "title": "é"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = R.read_jsonl(spark, str(tmp_path / "in.jsonl")).orderBy("pos").collect()
    assert [(r["rating"], r["title"], r["text"]) for r in rows] == [(4.0, "a", "b"), (1.0, None, None), (2.0, "é", None)]
    R.write_jsonl(R.read_jsonl(spark, str(tmp_path / "in.jsonl")), str(tmp_path / "out"))
    assert R.read_reviews(spark, str(tmp_path / "out")).count() == 3
    assert R.read_reviews(spark, str(tmp_path / "none")).count() == 300
    assert [r["text"] for r in R.read_reviews(spark, str(tmp_path / "in.jsonl")).orderBy("review_id").collect()] == ["a: b", ": ", "é: "]
    made = []
    for _ in range(2):
        R.cached(spark, str(tmp_path / "cache"), {"k": 1}, lambda: made.append(1) or spark.range(3))
    assert made == [1]


def test_sentiment_and_evaluation(spark):
    for avg, mean, want in ((2.0, 3.0, -1.0), (4.5, 3.0, 2.25), (3.0, 3.0, 0.0)):
        assert one(spark, scores.sentiment(F.col("a"), F.col("m")), a=avg, m=mean) == want
    assert [one(spark, scores.colour(F.lit(x).cast("double"))) for x in (1, 3, 5, None)] == ["rgb(255,0,0)", "rgb(127,127,0)", "rgb(0,255,0)", "rgb(127,127,0)"]
    df = spark.createDataFrame([(1.0, 1.4), (3.0, 3.5), (5.0, 4.0)], "rating double, prediction double")
    total, by, cells = evaluate.make_analysis(df)
    assert round(total.first()["mse"], 6) == 0.416667
    assert {r["score"]: round(r["mse"], 6) for r in by.collect()} == {1.0: 0.16, 3.0: 0.25, 5.0: 1.0}
    got = {(r["truth"], r["predicted"]): r["percent"] for r in cells.collect()}
    assert got[(1, 1)] == got[(3, 4)] == got[(5, 4)] == 100.0 and len(got) == 12
    assert [one(spark, scores.whole(F.lit(x))) for x in (2.5, 3.5)] == [2, 4]
    train = spark.createDataFrame([(1, "good good", 5.0), (2, "bad", 1.0)], "review_id long, text string, rating double")
    overall = sentiment.rating_stats(train)
    known = sentiment.word_sentiment(sentiment.word_stats(train), overall)
    test = spark.createDataFrame([(3, "good", 5.0), (4, "unseen words", 2.0), (5, "", 2.0)], "review_id long, text string, rating double")
    out = {r["review_id"]: (r["prediction"], r["n_unknown"]) for r in sentiment.predict(test, known, overall).collect()}
    assert out == {3: (5.0, 0), 4: (3.0, 2), 5: (3.0, 0)}


def test_tfidf_models(spark):
    r = np.random.default_rng(5)
    names = ["red", "green", "blue", "black", "white", "brown", "pink", "grey"]
    docs = [(i, " ".join(r.choice(names, 12)), float(i % 5 + 1)) for i in range(60)]
    df = spark.createDataFrame(docs, "review_id long, text string, rating double")
    with pytest.raises(ValueError):
        tfidf.TfidfVectorizer().transform(df)
    with pytest.raises(ValueError):
        tfidf.train(df, "other")
    vectorizer = tfidf.TfidfVectorizer(20)
    x = np.array([v["features"].toArray() for v in vectorizer.fit_transform(df).orderBy("review_id").collect()])
    y = np.array([d[2] for d in docs])
    rows = tfidf.vectors(tfidf.with_ngrams(df), tfidf.vocabulary(tfidf.with_ngrams(df), 20)).collect()
    dense = np.zeros_like(x)
    for row in rows:
        dense[row["review_id"], row["idx"]] = row["tfidf"]
    assert np.allclose(x, dense)
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    want = np.clip(y.mean() + centred @ w, 1, 5)
    model = tfidf.train(df, "ridge", 20, tol=1e-13)
    got = np.array([v["prediction"] for v in model.predict(df).orderBy("review_id").collect()])
    assert np.allclose(got, want, atol=1e-4)
    logistic = tfidf.train(df, "logistic", 20)
    assert {v["prediction"] for v in logistic.predict(df).collect()} <= {1.0, 2.0, 3.0, 4.0, 5.0}


def test_tfidf_save(spark, tmp_path):
    df = spark.createDataFrame([(i, "one two three" if i % 2 else "two four five", float(i % 2 * 4 + 1)) for i in range(20)], "review_id long, text string, rating double")
    model = tfidf.train(df)
    model.save(spark, str(tmp_path / "m"))
    again = tfidf.TfidfModel.load(spark, str(tmp_path / "m"), "ridge")
    assert [r["prediction"] for r in model.predict(df).orderBy("review_id").collect()] == [r["prediction"] for r in again.predict(df).orderBy("review_id").collect()]


def test_inner_product_votes(spark):
    index = spark.createDataFrame([(1, [0.8, 0.0], 5), (2, [-0.2, 0.0], 1), (3, None, 2)], "vec_id long, embedding array<float>, label int")
    queries = spark.createDataFrame([(9, [1.0, 0.0], 0), (8, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["prediction"] for r in knn.predict(index, queries).collect()}
    assert got == {9: 5.0, 8: 3.0}
    assert {r["prediction"] for r in knn.predict(index.limit(0), queries).collect()} == {3.0}


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    points = [(i, [float(x) for x in rng.normal(size=6)], i % 5) for i in range(200)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>, label int")
    assert np.allclose(kmeans.fit(df.limit(1), k=3, iterations=1), [np.array(df.first()["embedding"]) / np.linalg.norm(df.first()["embedding"])])
    centres = kmeans.fit(df, k=8, iterations=10)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1) and np.array_equal(centres, kmeans.fit(df.repartition(3), k=8, iterations=10))
    x = np.array([p[1] for p in points])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    owner = (x @ centres.T).argmax(axis=1)
    assigned = kmeans.assign(df, centres)
    assert {r["vec_id"]: r["cluster_id"] for r in assigned.collect()} == dict(enumerate(owner.tolist()))
    flat = spark.createDataFrame([(0, 4), (0, 2), (0, 4), (0, 2)], "cluster_id int, label int")
    assert [tuple(r) for r in kmeans.cluster_stats(flat, 2).orderBy("cluster_id").collect()] == [(0, 4, 3.0, 1.0, 2.0), (1, 0, 3.0, 0.0, 3.0)]


def test_kmeans_draws_from_all_rows(spark):
    # as many directions as rows: a centre that no batch has moved stays where it was drawn
    n = 400
    df = spark.createDataFrame([(i if i else None, [1.0 if j == i % 40 else 0.0 for j in range(40)]) for i in range(n)], "vec_id long, embedding array<double>")
    start = np.full((1, 40), 1 / 40**0.5)
    moved = kmeans.fit(df, k=1, batch=20, iterations=60, start=start)
    assert (moved > 0).all() and np.isclose(np.linalg.norm(moved), 1)
    assert len(kmeans.fit(df, k=50, batch=20, iterations=2)) == 50
    assert kmeans.fit(df.limit(0), k=3).shape == (0, 0)


def test_projection(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = rows.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in data], float)
    x -= x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in projection.project(rows, 3).orderBy("vec_id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_cloud_layout(spark):
    top = spark.createDataFrame([("g", i + 1, w, 20 - i) for i, w in enumerate(["alpha", "beta", "gamma", "delta", "eps"])], "stars string, rank int, word string, cnt long")
    rows = describe.cloud_layout(describe.cloud_scale(top, ["stars"]), "stars").orderBy("rank").collect()
    assert [rows[0]["x"], rows[0]["y"], rows[0]["fontsize"], rows[-1]["fontsize"]] == [0.0, 0.0, 45.0, 8.0]
    for i, a in enumerate(rows):
        for b in rows[:i]:
            assert abs(a["x"] - b["x"]) > (a["w"] + b["w"]) / 2 or abs(a["y"] - b["y"]) > (a["h"] + b["h"]) / 2


def test_pairs(spark):
    assert abs(one(spark, scores.agreement(F.lit(5.0), F.lit(2.0), F.lit(5.0))) - 0.4) < 1e-12
    loss = one(spark, pairs.pair_loss(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), F.lit(1.0)))
    assert abs(loss + math.log(1 / (1 + math.exp(-1 / 0.07)) + 1e-8)) < 1e-12
    texts = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, ""), (4, None)], "review_id long, text string")
    got = {r["review_id"]: r["embedding"] for r in pairs.encode_texts(texts).collect()}
    assert got[1] == got[2] and abs(sum(v * v for v in got[1]) - 1) < 1e-6 and not any(got[3]) and not any(got[4])
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_streams_add_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good good day", 5.0), (2, "bad day", 1.0)], "review_id long, text string, rating double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.add_word_stats(stream, str(tmp_path / "stats"), str(tmp_path / "c1")).awaitTermination(120)
    got = {r["word"]: (r["score"], r["cnt"], r["avg"]) for r in incremental.merged_word_stats(spark, str(tmp_path / "stats")).collect()}
    assert got == {"good": (10.0, 2, 5.0), "day": (6.0, 2, 3.0), "bad": (1.0, 1, 1.0)}
    incremental.add_signatures(stream, str(tmp_path / "sigs"), str(tmp_path / "c2"), 10).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "sigs")).count() == 2
