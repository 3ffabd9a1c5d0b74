"""The random forest on points against a plain re-statement."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caregap.operators import forest, ml

POINT = "x array<double>, y int, w double, n bigint"


def points(rows=150, seed=0):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 9, (rows, 4)) / 2, axis=0)
    y = np.digitize(x[:, 0] + x[:, 1] * rng.random(len(x)), [2.0, 4.0])
    return x, y, np.array([1.0, 2.5, 0.5])[y], rng.integers(1, 40, len(x))


def frame(spark, x, y, w, n, parts=3):
    rows = [(a.tolist(), int(b), float(c), int(d)) for a, b, c, d in zip(x, y, w, n, strict=True)]
    return spark.createDataFrame(rows, POINT).repartition(parts)


def plain_shares(tree, trees, depth, seed, x, y, w, n, bounds):
    """Shares of each point's leaf: Poisson(n) copies of a point, cut by cut, sibling leaves of one prediction merged."""
    weight = np.random.default_rng([seed, 2 ** (depth + 1) - 1, tree, 0]).poisson(n) * w
    total = lambda rows: np.bincount(y[rows], weights=weight[rows], minlength=3)
    shares = np.zeros((len(x), 3))

    def below(node, rows, level):
        """(is it a leaf, its prediction) after ``shares`` of the rows are set."""
        own = total(rows)
        shares[rows] = own / own.sum()
        best, found = (own**2).sum() / own.sum() * (1 + 1e-12), None
        for f in np.random.default_rng([seed, tree, node]).permutation(x.shape[1])[: math.ceil(math.sqrt(x.shape[1]))] if level < depth else []:
            for cut in bounds[f]:
                left, right = total(rows[x[rows, f] <= cut]), total(rows[x[rows, f] > cut])
                if left.sum() and right.sum() and (left**2).sum() / left.sum() + (right**2).sum() / right.sum() > best:
                    best, found = (left**2).sum() / left.sum() + (right**2).sum() / right.sum(), (f, cut)
        if found is None:
            return True, own.argmax()
        goes = x[rows, found[0]] <= found[1]
        sides = [below(2 * node + 1, rows[goes], level + 1), below(2 * node + 2, rows[~goes], level + 1)]
        if all(leaf for leaf, _ in sides) and sides[0][1] == sides[1][1]:
            shares[rows] = own / own.sum()
            return True, own.argmax()
        return False, own.argmax()

    below(0, np.arange(len(x)), 0)
    return shares


def test_forest_is_the_plain_one(spark):
    x, y, w, n = points()
    order = np.lexsort((w, y, *x.T))
    x, y, w, n = x[order], y[order], w[order], n[order]
    bounds = forest.bin_bounds(frame(spark, x, y, w, n), 4, 32)
    assert [len(b) for b in bounds] == [len(np.unique(c)) - 1 for c in x.T]
    for trees, depth in ((5, 4), (4, 1)):
        found = forest.fit(frame(spark, x, y, w, n), 3, trees, depth, seed=3).votes(x)
        expected = np.mean([plain_shares(t, trees, depth, 3, x, y, w, n, bounds) for t in range(trees)], axis=0)
        assert np.allclose(found, expected)


def test_tasks_blocks_and_copies_do_not_change_it(spark, monkeypatch):
    x, y, w, n = points(seed=1)
    one = forest.fit(frame(spark, x, y, w, n, 1), 3, 6, 3)
    copies = frame(spark, x, y, w, n, 5).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("n", F.lit(1))
    many = forest.fit(copies, 3, 6, 3)
    assert (one.columns == many.columns).all() and np.allclose(one.cuts, many.cuts) and np.allclose(one.shares, many.shares)
    monkeypatch.setattr(forest, "BLOCK", 40)  # other draws, the same kind of forest
    blocks = forest.fit(copies, 3, 40, 4)
    assert (blocks.votes(x).argmax(axis=1) == y).mean() > 0.75


def test_bounds_at_equal_shares_of_the_weight(spark):
    v = np.arange(1000.0)
    n = np.where(v < 100, 10, 1)  # 1,000 of 1,900 rows lie below 100
    x = np.stack([v, np.where(v < 500, 0.0, 1.0), np.full(1000, 7.0)], axis=1)
    many, two, same = forest.bin_bounds(frame(spark, x, np.zeros(1000), np.ones(1000), n), 3, 32)
    upto = np.cumsum(n) / n.sum()
    assert len(many) == 31
    assert all(upto[int(b)] >= i / 32 - 1e-6 > upto[int(b)] - n[int(b)] / n.sum() - 1e-6 for i, b in enumerate(many, 1))
    assert (two, same) == ([0.5], [])


def test_answers_by_id(spark):
    x, y, w, n = points(seed=2)
    grown = forest.fit(frame(spark, x, y, w, n), 3, 7, 3)
    asked = spark.createDataFrame([(i, x[i % 10].tolist()) for i in range(40)], "id bigint, x array<double>")
    found = {r["id"]: r["probability"] for r in grown.transform(asked).collect()}
    assert len(found) == 40 and np.allclose([found[i] for i in range(40)], grown.votes(x[:10])[[i % 10 for i in range(40)]])
    assert forest.fit(frame(spark, x, y, w, n).limit(0), 3, 2, 2) is None


@pytest.fixture(scope="module")
def suspects(spark):
    rng = np.random.default_rng(5)
    rows = [(f"B{i:04d}", "18", "EMERGING", ["LOW", "medium", " High "][i % 3], float(i % 3 + rng.integers(0, 2)), float(rng.integers(0, 3))) for i in range(600)]
    made = spark.createDataFrame(rows, "bene_id string, hcc_v28 string, gap_type string, disease_priority string, a double, b double")
    columns = [*ml.PRIORITY_NUMERIC, *ml.PRIORITY_SCORES]
    return made.withColumns({c: F.col("a" if i % 2 else "b") for i, c in enumerate(columns)}).drop("a", "b")


def test_comparison_learns_from_points(suspects, monkeypatch):
    """No learner but boosting's held-out rows sees an equal row twice; every row counts."""
    given = []
    fitted, shared = forest.fit, ml.extra_trees.class_shares
    monkeypatch.setattr(ml.forest, "fit", lambda train, *a, **k: (given.append(train), fitted(train, *a, **k))[1])
    monkeypatch.setattr(ml.extra_trees, "class_shares", lambda train, *a, **k: (given.append(train), shared(train, *a, **k))[1])
    report = ml.compare_models(suspects, trees=5, rounds=3, iterations=20).collect()
    assert sorted(r["model"] for r in report) == ["Extra Trees", "Histogram Boosting", "Logistic Regression", "Random Forest"]
    assert all(0.5 < r["accuracy"] <= 1 for r in report)
    assert all(t.count() == t.select("x", "y").distinct().count() <= 18 for t in given)
    assert given[0].agg(F.sum("n")).first()[0] == 480
