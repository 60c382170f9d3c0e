"""Steps whose work or tables used to grow faster than their input."""

import time

import numpy as np
from pyspark.sql import functions as F

from lexiloom.functions import vectors
from lexiloom.operators import allpairs, knn, lsh


def test_norm_is_taken_once_a_vector(spark):
    """100 vectors of 1,500 places: with a norm for each place these were 225 million products."""
    rows = spark.range(100).select(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: (F.col("id") + i).cast("double")).alias("v"))
    started = time.time()
    got = np.array([r[0] for r in rows.select(vectors.normalise(F.col("v"))).collect()])
    assert time.time() - started < 8 and np.allclose((got * got).sum(axis=1), 1)
    odd = spark.createDataFrame([([0.0, 0.0],), (None,), ([],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in odd.select(vectors.normalise(F.col("v"))).collect()] == [[0.0, 0.0], None, [], [0.6, 0.8]]


def signed(spark, rows):
    df = spark.createDataFrame(rows, "review_id long, rating double, sig array<bigint>")
    return df.withColumn("sig_id", F.md5(F.concat_ws(",", F.col("sig").cast("array<string>")).cast("binary"))).withColumn("has_shingles", F.exists("sig", lambda v: v != 0))


def no_pair_is_shuffled(df):
    """Blocks meet in a product of partitions, with no exchange above it before the blocks are reduced."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("MapInArrow") : plan.index("CartesianProduct")]
    return "Exchange" not in above


def test_pairs_of_several_blocks(spark, monkeypatch):
    """Links, sums, degrees, histogram and first links over many small blocks, against all pairs by hand."""
    monkeypatch.setattr(allpairs, "LEAST", 7)
    monkeypatch.setattr(allpairs, "TILE", 3)
    rng = np.random.default_rng(5)
    sigs = {int(v): rng.integers(1, 4, 12) for v in rng.choice(1000, 60, replace=False)}
    count = {v: int(rng.integers(1, 4)) for v in sigs}
    groups = spark.createDataFrame([(str(v), v, count[v], s.tolist()) for v, s in sigs.items()], "sig_id string, rep long, n long, sig array<bigint>")
    shared, links = [], []
    for a in sigs:
        for b in sigs:
            same = sigs[a] == sigs[b]
            if a < b and same.reshape(6, 2).all(axis=1).any():
                shared.append((a, b))
                if same.mean() > 0.4:
                    links.append((a, b, same.mean(), count[a], count[b]))
    assert links and len(links) < len(shared)
    got = lsh.candidate_sums(groups, (12, 6))
    assert no_pair_is_shuffled(got) and tuple(got.first()) == (len(shared), sum(a for a, _ in shared), sum(b for _, b in shared))
    assert sorted(map(tuple, lsh.near_duplicates(groups, (12, 6), 0.4).collect())) == sorted(links)
    members = {}
    for a, b, _, na, nb in links:
        members[a], members[b] = members.get(a, 0) + nb, members.get(b, 0) + na
    assert dict(map(tuple, lsh.linked_members(groups, (12, 6), 0.4).collect())) == members
    weights = lsh.link_counts(groups, (12, 6), 0.4).groupBy("similarity").agg(F.sum("n_src")).collect()
    assert {round(s, 9): n for s, n in weights} == {s: sum(x[3] * x[4] for x in links if round(x[2], 9) == s) for s in {round(x[2], 9) for x in links}}
    nodes = sorted(members)[:5]
    for head in (2, 0):
        some = lsh.first_links(groups, 5, (12, 6), 0.4, head)
        assert sorted(map(tuple, some.collect())) == sorted(x for x in links if x[0] in nodes and x[1] in nodes)
    assert tuple(lsh.candidate_sums(groups.limit(0), (12, 6)).first()) == (0, None, None)


def test_votes_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(allpairs, "LEAST", 40)
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(1, 6)), rng.integers(1, 4, 12).tolist()) for i in range(900)]
    train, test = rows[:700], rows[700:]
    got = {r["review_id"]: (r["prediction"], r["n_votes"]) for r in lsh.predict(signed(spark, train), signed(spark, test), params=(12, 6)).collect()}
    x, label = np.array([r[2] for r in train]), np.array([r[1] for r in train])
    for key, _, s in test:
        same = x == np.array(s)
        sim = np.where(same.reshape(-1, 6, 2).all(axis=2).any(axis=1), same.mean(axis=1), -1)
        best = np.lexsort((-label, -sim))[:5]
        best = best[sim[best] > 0]
        want = (sim[best] * label[best]).sum() / sim[best].sum() if len(best) else 3.0
        assert got[key][1] == len(best) and abs(got[key][0] - want) < 1e-9


def test_search_of_several_blocks(spark, monkeypatch):
    """Ties across blocks go to the smallest id; no block is shuffled for a pair."""
    for name, value in (("LEAST", 16), ("INDEX_BLOCK", 32), ("QUERY_BLOCK", 16), ("PIECE", 5), ("TOGETHER", 4)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(7)
    v = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for k in (3, None):
        found = knn.search(rows, rows.where("vec_id % 10 = 0"), k=k)
        assert no_pair_is_shuffled(found)
        got = sorted((r["query_id"], r["rank"], r["item_id"], r["sim"]) for r in found.collect())
        want = []
        for q in range(0, 300, 10):
            order = [i for i in np.lexsort((np.arange(300), -(v @ v[q]))) if i != q][:k]
            want += [(q, n + 1, i, float(v[i] @ v[q])) for n, i in enumerate(order)]
        assert got == want


def test_one_task_orders_little_more_than_the_first_rows(spark):
    """40 tasks send 50 rows each to the one that orders them where nothing is counted first."""
    from lexiloom.sources.reviews import first_rows

    rows = spark.range(0, 400_000, 3, 40).select(((F.col("id") * 7919) % 400_000).alias("review_id"))
    got = first_rows(rows, 50)
    want = sorted((i * 7919) % 400_000 for i in range(0, 400_000, 3))[:50]
    assert [r[0] for r in got.orderBy("review_id").collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" in plan
    assert first_rows(rows.limit(0), 50).count() == 0 and first_rows(rows.limit(7), 50).count() == 7


def test_encoder_hashes_a_token_once(spark):
    import zlib

    from lexiloom.operators.pairs import hashing_encoder

    texts = [["a", "b", "a"], [], ["é", "b"]]
    want = np.zeros((3, 16))
    for row, tokens in zip(want, texts):
        for t in tokens:
            h = zlib.crc32(t.encode())
            row[(h >> 1) % 16] += 1 if h & 1 else -1
    size = np.linalg.norm(want, axis=1, keepdims=True)
    encode = hashing_encoder(16)
    assert np.array_equal(encode(texts), np.divide(want, size, out=want, where=size > 0)) and encode([]).shape == (0, 16)
    calls, real = [], zlib.crc32
    zlib.crc32 = lambda t: calls.append(t) or real(t)
    try:
        hashing_encoder(16)([["same"] * 1000])
    finally:
        zlib.crc32 = real
    assert len(calls) == 1


def test_ngrams_are_counted_in_parts(spark, monkeypatch):
    """The number of parts grows with the text; n-grams are sent as they are, and no task has a table of more than its part."""
    from collections import Counter

    from lexiloom.operators import tfidf

    monkeypatch.setattr(tfidf, "PART", 200)
    texts = ["eins zwei drei", "eins zwei", "", None, "vier", "zwei eins zwei", "a1b c_d x über Ärger"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    grams, parts = tfidf.dealt(docs)
    assert parts == -(-sum(len((t or "").encode()) for t in texts) // 200) > 8
    counted = tfidf.doc_freq(grams, parts)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Exchange" not in plan[: plan.rindex("HashAggregate")]
    want = Counter()
    for t in texts:
        words = [w for w in (t or "").lower().split() if w.isalpha() and len(w) > 1]
        want.update({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})
    assert dict(map(tuple, counted.collect())) == want
    assert dict(map(tuple, tfidf.doc_freq(grams).collect())) == want
    top = tfidf.vocabulary(grams, 3, parts=parts).orderBy("idx").collect()
    assert [r["ngram"] for r in top] == sorted(sorted(want, key=lambda g: (-want[g], g))[:3])


def test_ngrams_of_every_size(spark):
    """No n-gram looks its tokens up by a slice of its own."""
    from lexiloom.functions import text as T

    tokens = [["a"], [], None, ["a", "b"], ["a", "b", "c", "a"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t array<string>")
    for lo, hi in ((1, 1), (1, 2), (2, 2), (1, 3), (3, 3)):
        got = df.select("i", T.ngrams(F.col("t"), lo, hi).alias("g"))
        want = [None if t is None and lo == 1 else [" ".join((t or [])[i : i + n]) for n in range(lo, hi + 1) for i in range(len(t or []) - n + 1)] for t in tokens]
        assert [r["g"] for r in got.orderBy("i").collect()] == want
        assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_letters_are_whole_words(spark):
    from lexiloom.functions import text as T

    odd = "a1bc abc_ _abc ab\U0001d400 \U0001d400\U0001d401 x \U0001d400 e\u0301t ñandú½ ab1 1ab über² İstanbul the an"
    rows = spark.createDataFrame([(odd,), (None,), ("",)], "text string")
    tested = F.filter(T.words(F.col("text")), lambda w: (F.length(w) > 1) & w.rlike(r"^\p{L}+$"))
    got = rows.select(tested.alias("a"), T.alpha_words(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and "istanbul" not in got[0]["b"] and "ab\U0001d400" in got[0]["b"]


def test_counts_of_words_sort_no_tokens(spark):
    """Words by first appearance, for any ids, without a sort of all tokens."""
    from lexiloom.functions import text as T
    from lexiloom.operators import describe, sentiment

    rows = [(-5, 1.0, "zwei eins"), (2**62 + 1, 2.0, "drei vier drei"), (2**33 * 7, 3.0, "eins vier fünf"), (9, 2.0, None)]
    reviews = spark.createDataFrame(rows, "review_id long, rating double, text string")
    first = {"zwei": (-5, 0), "eins": (-5, 1), "vier": (2**33 * 7, 1), "fünf": (2**33 * 7, 2), "drei": (2**62 + 1, 0)}
    stats = sentiment.word_stats(reviews)
    assert {r["word"]: tuple(r["first"]) for r in stats.collect()} == first
    assert [r["word"] for r in sentiment.top_words(stats).collect()] == ["eins", "vier", "drei", "zwei", "fünf"]
    ranked = describe.frequencies(reviews.withColumn("k", F.lit(1)), T.alpha_words(F.col("text")), ["k"])
    assert [r["word"] for r in ranked.orderBy("rank").collect()] == ["eins", "vier", "drei", "zwei", "fünf"]
    for df in (stats, ranked):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_cloud_words_find_words_at_once(spark):
    """The words of cleaned text, in a small multiple of the time that cleaning takes (about nine times before)."""
    from lexiloom.functions import text as T

    odd = "Ein schö-ner \u3000Tag\u200b's x\U0001d400y _a 12 z\x1cq e\u0301\x85w\xa0v"
    rows = spark.createDataFrame([(odd,), (None,), (" ",)], "text string")
    got = rows.select(T.cloud_words(F.col("text"), ["a"], 1).alias("a"), T.spaced(T.clean(F.col("text"))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and len(got[0]["a"]) > 8

    many = spark.range(0, 400, 1, 4).select(F.repeat(F.concat(F.lit("Wort und Worte "), F.col("id").cast("string")), 1000).alias("text")).persist()
    many.count()

    def seconds(column):
        times = []
        for _ in range(3):
            started = time.time()
            many.select(column).write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        return min(times)

    assert seconds(T.cloud_words(F.col("text"), ["und"])) < 4 * seconds(T.clean(F.col("text")))
    many.unpersist()


def test_sentiments_are_made_once(spark):
    """Predictions for several test tables read them, and don't count the training words anew."""
    from lexiloom.plans import wordwise

    sentiments, _, test = wordwise.learned(spark, "/root/testdata/sf0.001", "A")
    plan = sentiments._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    fitted, _, same = wordwise.fitted(spark, "/root/testdata/sf0.001", "A")
    assert sorted(map(tuple, sentiments.collect())) == sorted(map(tuple, fitted.select("word", "sentiment").collect())) and test.count() == same.count()
