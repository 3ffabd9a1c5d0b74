"""The logistic fit against a plain Newton iteration in numpy, and its certificate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caregap.operators import logistic, ml

FEATURES = ("a", "b", "k")


def sample(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(3, 2, n), rng.exponential(1, n), np.full(n, 7.0)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 3 - x[:, 1])))).astype(int)
    return x, y


def plain(x, y, c):
    """Coefficients by full Newton steps on the standardised matrix."""
    scale = x.std(axis=0)
    z = np.column_stack([(x - x.mean(axis=0)) / np.where(scale > 0, scale, 1), np.ones(len(x))])
    w = len(y) / (2 * np.bincount(y))[y]
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(np.eye(len(b)) + c * (z * (w * p * (1 - p))[:, None]).T @ z, b + c * z.T @ (w * (p - y)))
    return b, 1 / (1 + np.exp(-z @ b))


def frame(spark, x, y):
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)]
    return ml.class_weights(spark.createDataFrame(rows, "a double, b double, k double, target int").repartition(3))


@pytest.mark.parametrize("c", [0.01, 1.0, 500.0])
def test_equals_plain_newton(spark, c):
    x, y = sample()
    df = frame(spark, x, y).cache()
    fit = logistic.fit_logistic(df, FEATURES, "target", "class_weight", c)
    want, probability = plain(x, y, c)
    assert np.allclose(fit.coefficients, want, atol=1e-7)
    got = sorted(r.p for r in fit.transform(df, "p").select("p").collect())
    assert np.allclose(got, np.sort(probability), atol=1e-9)
    assert all(r.is_optimal for r in logistic.optimality(fit.transform(df, "p"), fit, "target", "class_weight", "p").collect())


def test_certificate_sees_another_model(spark):
    x, y = sample()
    df = frame(spark, x, y).cache()
    fit = logistic.fit_logistic(df, FEATURES, "target", "class_weight")
    other = logistic.LogisticFit(fit.features, fit.mean, fit.scale, tuple(b * 1.0001 for b in fit.coefficients), fit.c)
    report = logistic.optimality(other.transform(df, "p"), other, "target", "class_weight", "p")
    assert not all(r.is_optimal for r in report.collect())


def test_separable_and_single_class(spark):
    """A plane that separates the classes still has one penalised optimum; so has a single class."""
    x = np.array([[float(i), 0.0, 1.0] for i in range(20)])
    for y in ((np.arange(20) >= 10).astype(int), np.ones(20, dtype=int)):
        df = frame(spark, x, y)
        fit = logistic.fit_logistic(df, FEATURES, "target", "class_weight", 1000.0)
        assert all(r.is_optimal for r in logistic.optimality(fit.transform(df, "p"), fit, "target", "class_weight", "p").collect())


def test_no_rows(spark):
    with pytest.raises(ValueError):
        logistic.fit_logistic(spark.createDataFrame([], "a double, b double, k double, target int, w double"), FEATURES, "target", "w")


def test_out_of_fold_probabilities(spark):
    """Each row's probability is that of a plain fit on the other folds."""
    rng = np.random.default_rng(6)
    n = 150
    columns = {f: rng.integers(0, 6, n).astype(float) for f in ml.RECAPTURE_FEATURES}
    target = (rng.random(n) < 0.3 + 0.1 * (columns["active_years"] > 3)).astype(int)
    rows = [(f"b{i}", str(i % 7), int(target[i]), *(float(columns[f][i]) for f in columns)) for i in range(n)]
    df = spark.createDataFrame(rows, "bene_id string, hcc_v28 string, target int, " + ", ".join(f"{f} double" for f in columns))
    got = {r.bene_id: (r.fold, r.recapture_probability) for r in ml.out_of_fold(df).collect()}
    assert len(got) == n
    x = np.column_stack(list(columns.values()))
    fold = np.array([got[f"b{i}"][0] for i in range(n)])
    for k in range(5):
        seen = fold != k
        want, _ = plain(x[seen], target[seen], 1.0)
        scale = x[seen].std(axis=0)
        z = np.column_stack([(x[~seen] - x[seen].mean(axis=0)) / scale, np.ones((~seen).sum())])
        assert np.allclose([got[f"b{i}"][1] for i in np.flatnonzero(~seen)], 1 / (1 + np.exp(-z @ want)), atol=1e-8)
    assert ml.fold_optimality(df).filter(~F.col("is_optimal")).count() == 0
