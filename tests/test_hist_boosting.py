"""Histogram boosting against a plain re-statement, in one task and by passes of Spark."""

import math

import numpy as np
import pytest

from caregap.operators import hist_boosting as hb


def sample(n, seed=1, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 3, n), rng.integers(0, 40, n), np.full(n, 2)]).astype(float)
    y = np.digitize(x[:, 0] + x[:, 2] / 10 + rng.integers(0, 3, n), [5, 10])
    holes = rng.random(x.shape) < missing
    return [(i, [None if h else v for v, h in zip(r, gap)], int(k)) for i, (r, gap, k) in enumerate(zip(x.tolist(), holes, y))]


def goes(value, cut, left_if_missing):
    return left_if_missing if value is None else value <= cut


def plain_split(rows, g, h, min_leaf, middles):
    """(gain, column, cut, side of missing) over every midpoint and both sides, by sums over lists; None without a gain."""
    total_g, total_h = sum(g[i] for i, _ in rows), sum(h[i] for i, _ in rows)
    best = None
    for f, cuts in enumerate(middles):
        for cut in [*cuts, math.inf]:
            for side in (False, True):
                left = [i for i, x in rows if goes(x[f], cut, side)]
                n, gl, hl = len(left), sum(g[i] for i in left), sum(h[i] for i in left)
                if min(n, len(rows) - n) < min_leaf or min(hl, total_h - hl) < 1e-3 * hb.SCALE:
                    continue
                gain = (gl * gl / hl + (total_g - gl) ** 2 / (total_h - hl) - total_g**2 / total_h) / hb.SCALE
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    seen = any(x[f] is None for _, x in rows)
                    best = (gain, f, cut, side if seen else n > len(rows) - n)
    return best


def plain_boost(rows, classes, rounds, leaves, min_leaf, rate):
    """Raw scores of the training rows: the leaf with the greatest gain is split first, over and over."""
    columns = len(rows[0][1])
    middles = []
    for f in range(columns):
        values = sorted({x[f] for _, x, _ in rows if x[f] is not None})
        middles.append([(a + b) / 2 for a, b in zip(values, values[1:])])
    shares = [sum(y == k for _, _, y in rows) / len(rows) for k in range(classes)]
    raw = [[math.log(s) for s in shares] for _ in rows]
    for _ in range(rounds):
        steps = [[0.0] * classes for _ in rows]
        for k in range(classes):
            p = [math.exp(r[k] - max(r)) / sum(math.exp(v - max(r)) for v in r) for r in raw]
            g = [round((q - (y == k)) * hb.SCALE) for q, (_, _, y) in zip(p, rows)]
            h = [round(q * (1 - q) * hb.SCALE) for q in p]
            ends = [[(i, x) for i, (_, x, _) in enumerate(rows)]]
            while len(ends) < leaves:
                found = [(plain_split(e, g, h, min_leaf, middles), at) for at, e in enumerate(ends)]
                found = [(s, at) for s, at in found if s]
                if not found:
                    break
                (_, f, cut, side), at = max(found, key=lambda s: s[0][0])
                end = ends.pop(at)
                ends += [[r for r in end if goes(r[1][f], cut, side)], [r for r in end if not goes(r[1][f], cut, side)]]
            for end in ends:
                value = -rate * sum(g[i] for i, _ in end) / sum(h[i] for i, _ in end)
                for i, _ in end:
                    steps[i][k] = value
        raw = [[a + b for a, b in zip(r, s)] for r, s in zip(raw, steps)]
    return raw


@pytest.mark.parametrize("missing", [0.0, 0.15])
@pytest.mark.parametrize("local_rows", [10_000, 0])
def test_equals_plain_boosting(spark, local_rows, missing):
    rows = sample(150, missing=missing)
    train = spark.createDataFrame(rows, "id bigint, x array<double>, y int").repartition(3)
    booster = hb.fit(train, 3, rounds=3, leaves=6, min_leaf=8, local_rows=local_rows)
    assert len(booster.rounds) == 3 and max(len(t.values) for t in booster.rounds[0]) == 6
    got = {r.id: r.probability for r in booster.transform(train).collect()}
    want = hb.softmax(np.array(plain_boost(rows, 3, 3, 6, 8, hb.RATE)))
    assert sorted(got) == [i for i, _, _ in rows]
    for i, _, _ in rows:
        assert np.allclose(got[i], want[i], atol=1e-6)


def test_one_task_and_passes_grow_the_same_trees(spark):
    """Twelve rounds, so that raw scores are stored on the way; many values, so that bins hold several."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 3))
    y = np.digitize(x[:, 0] + 0.3 * rng.normal(size=700), [-0.4, 0.6])
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), y))]
    train = spark.createDataFrame(rows, "id bigint, x array<double>, y int")
    one = hb.fit(train, 3, rounds=12)
    passes = hb.fit(train.repartition(5), 3, rounds=12, local_rows=0)
    assert one.bounds == passes.bounds and max(map(len, one.bounds)) <= 254
    assert one.rounds == passes.rounds
    hits = [int(np.argmax(r.probability)) == rows[r.id][2] for r in one.transform(train).collect()]
    assert np.mean(hits) > 0.85


def test_held_out_rows_stop_the_training(spark):
    """Labels that nothing explains: the held-out loss soon rises."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b)], int(k)) for i, (a, b, k) in enumerate(zip(*rng.integers(0, 50, (2, 600)), rng.integers(0, 3, 600)))]
    train = spark.createDataFrame(rows, "id bigint, x array<double>, y int")
    assert len(hb.fit(train, 3, rounds=40, stop_from=100).rounds) < 40
    assert len(hb.fit(train, 3, rounds=40).rounds) == 40


def test_the_growth_is_best_first():
    """A child with a greater gain than its aunt is split before it, and nodes not yet known are asked for."""
    def node(gain):
        return hb.Split(100, 0, 1, gain, 0)

    known = {(0, ""): node(9), (0, "L"): node(2), (0, "R"): node(5), (0, "RL"): node(4), (0, "RR"): hb.Split(5, 0, 1)}
    assert hb.chosen_splits(known, 0, 4) == (["", "R", "RL"], [])
    assert hb.chosen_splits(known, 0, 5) == (["", "R", "RL", "L"], [(0, "RLL"), (0, "RLR")])


def test_edges(spark):
    schema = "id bigint, x array<double>, y int"
    assert hb.fit(spark.createDataFrame([], schema), 3) is None
    asked = spark.createDataFrame([(1, [None, float("nan")])], "id bigint, x array<double>")
    # One class, equal rows, missing columns: no tree, the class shares remain.
    for rows, shares in (([(i, [1.0, None], 1) for i in range(60)], [0, 1, 0]), ([(i, [1.0, None], i % 2) for i in range(60)], [0.5, 0.5, 0])):
        for limit in (0, 100):
            booster = hb.fit(spark.createDataFrame(rows, schema), 3, local_rows=limit)
            assert booster.rounds == []
            assert np.allclose(booster.transform(asked).first().probability, shares, atol=1e-6)
            assert booster.transform(asked.limit(0)).count() == 0
    # Whether a value is missing is all there is to learn.
    rows = [(i, [None if i % 2 else float(i % 7)], i % 2) for i in range(80)]
    booster = hb.fit(spark.createDataFrame(rows, schema), 2, rounds=5)
    known = spark.createDataFrame([(1, [None]), (2, [3.0]), (3, [99.0])], "id bigint, x array<double>")
    assert [int(np.argmax(r.probability)) for r in booster.transform(known).orderBy("id").collect()] == [1, 0, 0]


def test_equal_rows_are_one_point(spark, monkeypatch):
    """Copies of few points stay in one task; passes over them grow the same trees."""
    rows = [(i, x, y) for i, (_, x, y) in enumerate(sample(70) * 5)]
    train = spark.createDataFrame(rows, "id bigint, x array<double>, y int").repartition(3)
    passes = hb.fit(train, 3, rounds=3, local_rows=0, stop_from=100)

    def by_passes(*_):
        raise AssertionError("few points were fitted by passes")

    monkeypatch.setattr(hb, "_fit_by_passes", by_passes)
    one = hb.fit(train, 3, rounds=3, local_rows=150, stop_from=100)
    assert one.rounds == passes.rounds and len(one.rounds) == 3
