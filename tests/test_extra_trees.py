"""Extra trees against a plain recursive re-statement, in one task and split by Spark."""

from hashlib import md5

import numpy as np
import pytest

from caregap.operators import extra_trees


def number(*key):
    return (int(md5("|".join(str(k) for k in key).encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def plain(seed, tree, path, rows, query):
    """Leaf shares of one query by plain recursion over lists of (x, y, w)."""
    total = [sum(w for _, y, w in rows if y == k) for k in range(3)]
    columns = [f for f in range(len(query)) if len({x[f] for x, _, _ in rows}) > 1]
    if sum(t > 0 for t in total) <= 1 or not columns:
        return [t / sum(total) for t in total]
    best = None
    for f in sorted(columns, key=lambda f: number(seed, tree, path, f))[: max(1, int(len(query) ** 0.5))]:
        low, high = min(x[f] for x, _, _ in rows), max(x[f] for x, _, _ in rows)
        cut = low + number(seed, tree, path, f, "cut") * (high - low)
        sides = [[r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]]
        score = 0
        for side in sides:
            weights = [sum(w for _, y, w in side if y == k) for k in range(3)]
            score += sum(v * v for v in weights) / sum(weights)
        if best is None or score > best[0]:
            best = (score, f, cut, sides)
    _, f, cut, sides = best
    return plain(seed, tree, path + "L", sides[0], query) if query[f] <= cut else plain(seed, tree, path + "R", sides[1], query)


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 3, n), rng.integers(0, 40, n), np.full(n, 2), rng.integers(0, 5, n)]).astype(float)
    y = np.digitize(x[:, 0] + x[:, 2] / 10 + rng.integers(0, 2, n), [4, 8])
    return [(r.tolist(), int(k), 1.0 + int(k)) for r, k in zip(x, y, strict=True)]


@pytest.mark.parametrize("local_rows", [10_000, 40])
def test_trees_equal_plain_recursion(spark, local_rows):
    rows, queries = sample(180), [(i, x) for i, (x, _, _) in enumerate(sample(30, 2))]
    train = spark.createDataFrame(rows, "x array<double>, y int, w double").repartition(3)
    asked = spark.createDataFrame(queries, "id bigint, x array<double>")
    got = {r.id: r.probability for r in extra_trees.class_shares(train, asked, 3, trees=4, seed=7, local_rows=local_rows).collect()}
    assert sorted(got) == [i for i, _ in queries]
    for i, x in queries:
        want = np.mean([plain(7, t, "", rows, x) for t in range(4)], axis=0)
        assert np.allclose(got[i], want)


def test_a_large_pure_node_and_equal_rows(spark):
    """One class alone and rows that no column tells apart end in leaves, also where Spark splits."""
    for rows, share in (([([1.0, 2.0], 1, 1.0)] * 60, [0, 1, 0]), ([([1.0, 2.0], i % 2, 1.0) for i in range(60)], [0.5, 0.5, 0])):
        train = spark.createDataFrame(rows, "x array<double>, y int, w double")
        asked = spark.createDataFrame([(5, [1.0, 2.0]), (6, [9.0, 9.0])], "id bigint, x array<double>")
        for limit in (10, 1000):
            found = extra_trees.class_shares(train, asked, 3, trees=3, local_rows=limit).collect()
            assert {r.id: r.probability for r in found} == {5: share, 6: share}


def test_no_rows(spark):
    train = spark.createDataFrame(sample(20), "x array<double>, y int, w double")
    asked = spark.createDataFrame([(1, [0.0] * 5)], "id bigint, x array<double>")
    assert extra_trees.class_shares(train.limit(0), asked, 3, trees=2).count() == 0
    assert extra_trees.class_shares(train, asked.limit(0), 3, trees=2).count() == 0


def test_roots_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.createDataFrame([([float(i % 7), float(i % 3)], i % 2, 1.0) for i in range(50)], "x array<double>, y int, w double")
    roots = extra_trees.root_cuts(rows.mapInPandas(counted, rows.schema), 2, 5)
    assert sorted(r.tree for r in roots.collect()) == [0, 1, 2, 3, 4]
    assert seen.value == 50


def test_equal_rows_are_one_point(spark, monkeypatch):
    """Copies of few points stay in one task and give the trees of the points with their weights added up."""
    points, copies = sample(60), 6
    few = [(x, y, w * copies) for x, y, w in points]
    schema, queries = "x array<double>, y int, w double", [(i, x) for i, (x, _, _) in enumerate(sample(20, 2) * 3)]
    asked = spark.createDataFrame(queries, "id bigint, x array<double>")
    want = {r.id: r.probability for r in extra_trees.class_shares(spark.createDataFrame(few, schema), asked, 3, trees=3).collect()}

    def split(*_):
        raise AssertionError("80 points were split by Spark")

    monkeypatch.setattr(extra_trees, "_splits", split)
    train = spark.createDataFrame(points * copies, schema).repartition(3)
    got = {r.id: r.probability for r in extra_trees.class_shares(train, asked, 3, trees=3, local_rows=100).collect()}
    assert sorted(got) == [i for i, _ in queries]
    assert all(np.allclose(got[i], want[i]) for i in got)
