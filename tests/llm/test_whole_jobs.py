"""Small tests that each job is done over all of its input."""

import base64
import random
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from lexiloom.llm import op7_packing, registry

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import both, connect  # noqa: E402

from .helpers import prose

SF = "/root/testdata/sf0.01"


def _packed_in_order(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = op7_packing.pack(docs, op7_packing.default_path(), window).collect()
    starts = sorted((p["sequence_id"], p["offset"], p["doc_id"]) for p in pieces if p["start"] == 0)
    return [r[2] for r in starts]


def test_op7_neighbours_come_from_all_documents(spark):
    """With one lane every document that follows is the unused one of the whole table with the largest BM25."""
    rows = [(i, prose(i % 300, 12) + " " + prose(1000 + i, 4)) for i in range(600)]  # i and i + 300 are alike
    window = 600 * 70
    got = _packed_in_order(spark, rows, window)
    assert sorted(got) == list(range(600))
    tok = op7_packing.WordTokenizer(op7_packing.default_path())
    ids = [np.append(np.frombuffer(tok.whole(t), np.uint16), op7_packing.END) for _, t in rows]
    tf = np.zeros((600, 65536))
    for i, x in enumerate(ids):
        np.add.at(tf[i], x, 1)
    df, size = (tf > 0).sum(axis=0), tf.sum(axis=1)
    idf = np.log1p((600 - df + 0.5) / (df + 0.5))
    w = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[:, None] / size.mean()))
    score = (tf[got[0]] > 0) @ w.T
    assert sum(size) < window and np.all(np.diff(score[got[1:]]) <= 1e-3)


def test_pipeline_rejects_texts_without_a_language(spark):
    """Blobs, key dumps and text of no learned language go; all documents of the table stay."""
    r = random.Random(5)
    blob = lambda n: base64.b64encode(r.randbytes(n)).decode()
    word = lambda a: "".join(r.choice(a) for _ in range(r.randrange(3, 9)))
    junk = [blob(900), blob(300), " ".join(f"key_{blob(9)}={blob(15)}" for _ in range(40)), " ".join(word("zxqvkjwy") for _ in range(150)), " ".join(word("абвгдежзиклмнопрст") for _ in range(150))]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(900_000 + i, t, "en" if i == 0 else None, "s", len(t)) for i, t in enumerate(junk)] + [(900_100, "12 34", None, "s", 5), (900_101, None, None, "s", 0)]
    planted = spark.createDataFrame(rows, docs.schema)
    got = sorted(r[0] for r in corpus_pipeline.language_id(spark, docs.unionByName(planted), SF).select("doc_id").collect())
    assert got == sorted(r[0] for r in docs.where("text rlike '[a-zA-Z]'").select("doc_id").collect())


@pytest.mark.parametrize("name", ["op5_embedding_near_dedup", "op8_minhash_near_dedup"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got, want = both(spark, connect(sf), sf, registry.QUERIES[name], registry.ORACLE[name])
    assert got == want and got
