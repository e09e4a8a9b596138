"""Reweighted least squares and the SQL hooks against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from methloom.operators import scoring


def newton(x, y, w, penalty, rounds=12):
    x = np.insert(x, 0, 1.0, axis=1)
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * beta)
    return beta


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5, 0.0, 0.0] - 0.7)))).astype(int)
    return x, y, rng.integers(0, 3, 400)


def test_weights_of_all_and_of_folds(spark, rows):
    x, y, fold = rows
    data = [(list(map(float, v)), int(t), int(f)) for v, t, f in zip(x, y, fold, strict=True)] + [(None, 1, 0), ([1.0] * 5, None, 0)]
    df = spark.createDataFrame(data, "vector array<double>, label int, f int").repartition(5)
    w = np.where(y == 1, 3.0, 1.0)
    got = scoring.fit_logistic(df, positive_weight=3.0, penalty=0.2, fold=F.col("f"), folds=3)
    assert got.shape == (4, 6) and got[-1] == pytest.approx(newton(x, y, w, 0.2), abs=1e-6)
    for k in range(3):
        assert got[k] == pytest.approx(newton(x[fold != k], y[fold != k], w[fold != k], 0.2), abs=1e-6)
    assert scoring.fit_logistic(df, positive_weight=3.0, penalty=0.2)[0] == pytest.approx(got[-1], abs=1e-9)
    scored = scoring.apply_logistic(df.where("vector is not null"), got).collect()
    want = 1 / (1 + np.exp(-(np.insert(np.array([r.vector for r in scored]), 0, 1, axis=1) @ got[-1])))
    assert [r.prob_1 for r in scored] == pytest.approx(want) and all(r.predicted == (r.prob_1 > 0.5) for r in scored)
    out = scoring.apply_logistic(df.where("vector is not null"), got, fold=F.col("f")).collect()
    assert [r.prob_1 for r in out] == pytest.approx([1 / (1 + np.exp(-(np.array([1.0, *r.vector]) @ got[r.f]))) for r in out])
    right = np.mean([r.predicted == r.label for r in out if r.label is not None])
    assert right > 0.65


def test_no_labelled_rows(spark):
    with pytest.raises(ValueError):
        scoring.fit_logistic(spark.createDataFrame([(None, 1)], "vector array<double>, label int"))


def test_hooks_over_tables(spark):
    scoring.register_hooks(spark)
    reads = spark.createDataFrame([("a", "CGCGA"), ("b", None), ("c", ""), ("d", "GATTC"), ("e", "C"), ("f", "GCG")], "read_id string, seq string")
    got = spark.sql("select * from read_motifs(table(select read_id, seq from {r}), 'CG')", r=reads).collect()
    assert sorted((r.read_id, r.loc) for r in got) == [("a", 0), ("a", 2), ("f", 1)]
    assert spark.sql("select * from read_motifs(table(select read_id, seq from {r}), 'CGC')", r=reads).count() == 1
    calls = spark.createDataFrame([("x", 0.0), ("x", 0.01), ("x", 1.0), ("y", None)], "k string, p double")
    hist = {r.k: list(r.h) for r in spark.sql("select k, prob_histogram(p) as h from {c} group by k", c=calls).collect()}
    assert hist["x"][0] == pytest.approx(2 / 5**0.5, abs=1e-6) and hist["x"][19] == pytest.approx(1 / 5**0.5, abs=1e-6) and hist["y"] == [0.0] * 20


def test_histogram_aggregate_calls_no_python(spark):
    """An expression of counts, equal to the Python aggregate for any argument, with or without groups; registered again, it still works."""
    rng = np.random.default_rng(3)
    values = [None, float("nan"), -0.5, 0.0, 0.05, 0.95, 1.0, 7.5, *rng.random(300)]
    calls = spark.createDataFrame([(i % 40, float(p) if p is not None else None) for i, p in enumerate(values)] + [(99, None)], "k int, p double")
    for _ in range(2):
        scoring.register_hooks(spark)
        text = "select k, prob_histogram{over}(1 - p) as h from {c} group by k"
        got, want = (spark.sql(text.replace("{over}", over), c=calls) for over in ("", "_over"))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.k: list(r.h) for r in got.collect()} == {r.k: list(r.h) for r in want.collect()}
        assert len(spark.sql("select prob_histogram(p) as h from {c}", c=calls).first().h) == 20
    over = spark.sql("select prob_histogram_over(p) over (partition by k) as h from {c}", c=calls)
    assert over.count() == calls.count()
