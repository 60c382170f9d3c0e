import corpus_pipeline
from lexiloom.llm import op3_line_dedup, op8_minhash, op10_decontaminate

from .helpers import components, shingle_set

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
    ids = {k: [{r[0] for r in d.select("doc_id").collect()} for d in v] for k, v in seen.items()}
    assert all(b >= a and len(a) > 0.5 * len(b) for b, a in ids.values())
    rejected = {r[0] for r in seen["language_id"][0].where("text is null or not text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert ids["language_id"][0] - ids["language_id"][1] == rejected
    assert op3_line_dedup.repeated_lines(seen["line_dedup"][1]).selectExpr("sum(n_copies)").first()[0] == 0
    before, after = seen["minhash_near_dedup"]
    sets = {r[0]: shingle_set(r[1], 5) for r in before.select("doc_id", "text").collect()}
    order = sorted(sets)
    links = [(a, b) for x, a in enumerate(order) for b in order[x + 1 :] if sets[a] and not sets[a].isdisjoint(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(order, links)
    assert ids["minhash_near_dedup"][1] == {i for i in order if comp[i] == i}
    before, after = seen["decontamination"]
    leaks = {r[0] for r in op10_decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids["decontamination"][0] - ids["decontamination"][1] == leaks
    pieces = corpus_pipeline.STAGES[-1][1](spark, after, SF)
    got = {r["doc_id"]: (r["n"], r["t"]) for r in pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "t").collect()}
    assert set(got) == ids["decontamination"][1] and all(n == t for n, t in got.values())


def test_awkward_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no number but words", "en", "s", 3), (3, "some words of a text", None, None, None), (3, "some words of a text", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stage(spark, docs.limit(0), SF).collect()
    assert docs.columns == COLUMNS and {r[0] for r in docs.select("doc_id").collect()} <= {None, 3}
    assert op8_minhash.near_duplicates(docs).count() == docs.count()
