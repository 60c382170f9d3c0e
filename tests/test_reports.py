"""Reports and encoded predictors that no SQL holds, against numpy on a small table."""

import numpy as np
import pytest

from lexiloom.operators import evaluate
from lexiloom.plans import QUERIES, reports

SF = "/root/testdata/sf0.001"


def by_hand(rows, domain="all"):
    """Rows of the report of (rating, prediction) pairs."""
    t, p = (np.array(v, float) for v in zip(*rows))
    off = np.abs(p - t)
    out = {(domain, "overall", None, None): (np.where(np.round(off, 9) >= 0.5, off**2, 0).mean(), len(t))}
    predicted = np.rint(p).astype(int)
    for r in sorted(set(t.astype(int))):
        of = t == r
        out[(domain, "score", r, None)] = (((p - t)[of] ** 2).mean(), of.sum())
        for c in sorted(set(t.astype(int)) | set(predicted)):
            n = (of & (predicted == c)).sum()
            out[(domain, "confusion", r, c)] = (100 * n / of.sum(), n)
    return out


def as_dict(df):
    return {(r["domain"], r["part"], r["truth"], r["predicted"]): (r["value"], r["n"]) for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6), k


def test_report_by_hand_and_on_no_rows(spark):
    rows = [(1.0, 1.4), (1.0, 2.5), (3.0, 3.5), (5.0, 0.0), (5.0, 5.0)]
    same(as_dict(evaluate.report(spark.createDataFrame(rows, "rating double, prediction double"), "x")), by_hand(rows, "x"))
    assert evaluate.report(spark.createDataFrame([], "rating double, prediction double")).collect() == []


def neighbours(index, queries):
    """Votes of the five largest inner products, ties by id."""
    ids, labels, x = np.array([r[0] for r in index]), np.array([r[1] for r in index]), np.array([r[2] for r in index], float)
    out = {}
    for key, rating, v in queries:
        sim = np.round(x @ np.array(v, float), 12)
        best = np.lexsort((ids, -sim))[:5]
        w = np.maximum(sim[best], 0)
        out[key] = (rating, (w * labels[best]).sum() / w.sum() if w.sum() > 0 else labels[best].mean())
    return out


def test_encoded_inner_product_against_numpy(spark):
    train, test = ([(r["review_id"], r["rating"], r["embedding"]) for r in df.collect()] for df in reports.encoded(spark, SF))
    want = neighbours(train, test)
    got = {r["review_id"]: (r["rating"], r["prediction"]) for r in QUERIES["encoded_ip_predict"](spark, SF).collect()}
    assert got and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_encoded_inner_product_across_domains(spark):
    train = [(r["review_id"], r["rating"], r["embedding"]) for r in reports.encoded(spark, SF, "A")[0].collect()]
    want = {}
    for d in ("A", "B"):
        test = [(r["review_id"], r["rating"], r["embedding"]) for r in reports.encoded(spark, SF, d)[1].collect()]
        want |= by_hand([(t, round(p, 6)) for t, p in neighbours(train, test).values()], d)
    same(as_dict(QUERIES["encoded_ip_cross_domain"](spark, SF)), want)


@pytest.mark.parametrize("name", ["tfidf_ridge", "tfidf_logistic"])
def test_report_of_linear_models(spark, monkeypatch, name):
    """The report is of the model's own predictions; these are held in test_goldens."""
    rows = [(float(i % 5 + 1), 1 + (i * 0.37) % 4) for i in range(40)]
    monkeypatch.setattr(reports.training, f"{name}_predict", lambda *_: spark.createDataFrame(rows, "rating double, prediction double"))
    same(as_dict(QUERIES[f"eval_{name}"](spark, f"planted/{name}")), by_hand(rows))


def test_encoded_clusters(spark):
    """Every test row gets a vote between the ratings; both domains are reported in full."""
    rows = QUERIES["encoded_kmeans_predict"](spark, SF).collect()
    assert len(rows) == reports.encoded(spark, SF)[1].count() and all(1 <= r["prediction"] <= 5 for r in rows)
    got = as_dict(QUERIES["encoded_kmeans_cross_domain"](spark, SF))
    for d in ("A", "B"):
        assert got[(d, "overall", None, None)][1] == reports.encoded(spark, SF, d)[1].count()
