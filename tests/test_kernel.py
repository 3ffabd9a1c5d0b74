"""The kernel classifier's parts against plain re-statements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caregap.operators import kernel, ml


def test_features_approach_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    fourier = kernel.FourierFeatures(5, 0.2, 6000)
    z = fourier.expand(x)
    exact = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.06
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    assert np.allclose(np.array([r.z for r in fourier.transform(rows).collect()]), z)


def training(n, seed=0):
    """Rings: no plane separates the classes."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.digitize((x**2).sum(axis=1) + 0.2 * rng.normal(size=n), [0.8, 2.2])
    return x, y, rng.integers(0, 3, n), n / (3 * np.bincount(y, minlength=3))[y]


def dual_ascent(z, sign, bound, rounds=400):
    """Coordinate ascent on the dual: a second way to the same optimum."""
    alpha, w, q = np.zeros(len(z)), np.zeros(z.shape[1]), (z**2).sum(axis=1)
    for _ in range(rounds):
        for i in range(len(z)):
            new = np.clip(alpha[i] + (1 - sign[i] * (z[i] @ w)) / q[i], 0, bound[i])
            w += (new - alpha[i]) * sign[i] * z[i]
            alpha[i] = new
    return alpha.sum() - w @ w / 2


def test_machines_reach_the_optimum(spark):
    x, y, fold, weight = training(240)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(f), float(w)) for a, b, f, w in zip(x, y, fold, weight, strict=True)],
                                 "x array<double>, y int, fold int, weight double").repartition(3)
    fourier = kernel.FourierFeatures(2, 0.5, 24)
    machines = [kernel.Machine(0, 1), kernel.Machine(0, 2), kernel.Machine(1, 2), kernel.Machine(0, 2, 1)]
    kernel.fit_machines(rows, fourier, machines, 2.0)
    z = np.hstack([fourier.expand(x), np.ones((len(x), 1))])
    for m in machines:
        own = np.isin(y, (m.plus, m.minus)) & (True if m.fold is None else fold != m.fold)
        sign, bound = np.where(y[own] == m.plus, 1.0, -1.0), 2.0 * weight[own]
        loss = m.weights @ m.weights / 2 + bound @ np.maximum(0, 1 - sign * (z[own] @ m.weights))
        best = dual_ascent(z[own], sign, bound)
        assert loss == pytest.approx(m.loss)
        assert -1e-6 * loss <= loss - best <= (kernel.GAP if m.fold is None else kernel.FOLD_GAP) * loss * 1.01
        assert loss - best <= m.gap + 1e-6 * loss


def test_labels_that_hardly_depend_on_the_features_are_fitted(spark):
    """All slacks lie near one, so that no row bends the loss once the smoothing is below it."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 2)), rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(a.tolist(), int(b), 0, 50.0) for a, b in zip(x, y, strict=True)],
                                 "x array<double>, y int, fold int, weight double").repartition(3)
    machine = kernel.Machine(0, 1)
    kernel.fit_machines(rows, kernel.FourierFeatures(2, 0.05, 16), [machine], 2.0, steps=60)
    assert 0 <= machine.gap <= kernel.GAP * machine.loss
    assert machine.loss < 2.0 * 50 * 500  # less than without weights


def test_sigmoid_is_the_best_one(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * f + 0.5))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(f, y, strict=True)], "f double, y int")
    a, b = kernel.fit_sigmoid(rows, "f", F.col("y") == 1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(a, b):
        s = a * f + b
        return (target * np.logaddexp(0, s) + (1 - target) * (np.logaddexp(0, s) - s)).sum()

    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert a < 0  # a larger decision is a larger probability


def test_coupling_minimises_its_squares():
    rng = np.random.default_rng(9)
    for _ in range(20):
        r = np.full((3, 3), 0.5)
        for i, j in ((0, 1), (0, 2), (1, 2)):
            r[i, j] = rng.uniform(0.02, 0.98)
            r[j, i] = 1 - r[i, j]
        p = kernel.coupled(r[None])[0]

        def squares(p, r=r):
            return sum((r[j, i] * p[i] - r[i, j] * p[j]) ** 2 for i in range(3) for j in range(3) if i != j)

        assert math.isclose(p.sum(), 1) and (p >= 0).all()
        moves = [np.array(d) * 1e-3 for d in ((1, -1, 0), (1, 0, -1), (0, 1, -1))]
        assert all(squares(p) <= squares(p + s * d) + 1e-12 for d in moves for s in (-1, 1) if (p + s * d >= 0).all())


def test_whole_classifier(spark):
    """Labels on rings of two features, with nulls and an unseen category when scoring."""
    x, y, _, _ = training(300, 3)
    names = ["LOW", "medium ", "High"]
    rows = spark.createDataFrame(
        [(f"b{i}", "18", float(a), None if i % 50 == 0 else float(b), "G", "x" if i % 2 else None, names[k]) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))],
        "bene_id string, hcc_v28 string, diagnosis_count double, unique_claim_count double, gap_type string, status string, disease_priority string",
    )
    full = ml.with_priority_columns(rows.withColumns({c: F.lit(1.0) for c in ml.PRIORITY_NUMERIC[2:]}))
    model = kernel.fit_kernel(full, width=64, folds=3)
    scored = ml.priority_columns(model.transform(full)).collect()
    assert sum(r.ml_priority == r.disease_priority.strip().upper() for r in scored) > 0.75 * len(scored)
    assert all(abs(r.ml_low_probability + r.ml_medium_probability + r.ml_high_probability - 1) < 1e-3 for r in scored)
    assert model.transform(full.limit(0)).count() == 0
    new = full.withColumn("status", F.lit("never seen"))
    assert model.transform(new).count() == 300


def test_equal_rows_are_one_point(spark, monkeypatch):
    """Machines, gamma and sigmoids see each distinct row once, with its number; the model is that of the single rows."""
    x, y, _, _ = training(120, 5)
    names = ["LOW", "MEDIUM", "HIGH"]
    few = spark.createDataFrame(
        [(f"b{i}", "18", float(a), float(b), "G", "x", names[k]) for i, ((a, b), k) in enumerate(zip(x.round(1), y, strict=True))],
        "bene_id string, hcc_v28 string, diagnosis_count double, unique_claim_count double, gap_type string, status string, disease_priority string",
    )
    few = ml.with_priority_columns(few.withColumns({c: F.lit(1.0) for c in ml.PRIORITY_NUMERIC[2:]}))
    copies = F.when(F.col("disease_priority") == "LOW", 6).otherwise(2)
    rows = few.withColumn("i", F.explode(F.sequence(F.lit(1), copies))).drop("i")
    seen, fitted = [], kernel.fit_machines
    monkeypatch.setattr(kernel, "fit_machines", lambda data, *a, **k: (seen.append(data), fitted(data, *a, **k)))
    model = kernel.fit_kernel(rows, width=32, folds=3)
    distinct = few.select(*ml.PRIORITY_NUMERIC, "status", "disease_priority").distinct().count()
    assert seen[0].count() == distinct < rows.count()
    assert seen[0].agg(F.sum("n")).first()[0] == rows.count()

    # The same from single rows.
    _, data = ml.prepared_priority(rows)
    data = data.select(kernel.vector_to_array("features").alias("x"), F.col("target").cast("int").alias("y"), F.col("class_weight").alias("weight"))
    data = kernel.materialize(data.withColumn("fold", F.pmod(F.xxhash64("x", "y"), F.lit(3)).cast("int")))
    size, gamma = kernel.scale_gamma(data)
    assert model.fourier.gamma == pytest.approx(gamma) and model.fourier.size == size
    single = [kernel.Machine(0, 1), kernel.Machine(0, 2), kernel.Machine(1, 2)]
    fitted(data, model.fourier, single, kernel.INVERSE_PENALTY)
    assert all(np.allclose(a.weights, b.weights, atol=1e-6) for a, b in zip(model.machines, single, strict=True))


def test_sigmoid_counts_equal_rows(spark):
    rows = spark.createDataFrame([(0.5, 1, 3), (-0.2, 1, 1), (-1.0, 0, 4), (0.3, 0, 2)], "f double, y int, n bigint")
    single = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    counted = kernel.fit_sigmoid(rows, "f", F.col("y") == 1, count=F.col("n"))
    assert counted == pytest.approx(kernel.fit_sigmoid(single, "f", F.col("y") == 1))


def test_nothing_to_learn_from(spark):
    with pytest.raises(ValueError):
        kernel.scale_gamma(spark.createDataFrame([], "x array<double>"))
