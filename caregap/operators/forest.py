"""Random forest of a fixed depth: bootstrapped trees on binned columns, weighted Gini, the best cut of a few columns per node.

Rows with equal columns, class and weight are one point with their number: a bootstrap that
takes each row a Poisson(1) number of times takes a point of n rows a Poisson(n) number of
times. All trees grow a level per pass. A pass adds the drawn weights up by (tree, node,
column, bin, class) inside the tasks; the best cuts are chosen from these sums in tasks, too,
so only cuts reach the driver. Draws depend on seed, tree and a hash of the points, not on the
number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.operators.ranking import running_totals
from caregap.session import materialize

TREES, DEPTH, BINS = 400, 6, 32
# Points of one unit of work; a unit with all trees takes about a minute and some 100 MB.
BLOCK = 50_000


@dataclass(frozen=True)
class Forest:
    """Column (-1 in a leaf), cut and class shares by (tree, node); the children of node i are 2i + 1 and 2i + 2."""

    columns: np.ndarray
    cuts: np.ndarray
    shares: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares over the leaves that each row reaches."""
        total, rows = np.zeros((len(x), self.shares.shape[2])), np.arange(len(x))
        for columns, cuts, shares in zip(self.columns, self.cuts, self.shares, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while (moves := columns[node] >= 0).any():
                right = x[rows, columns[node]] > cuts[node]
                node = np.where(moves, 2 * node + 1 + right, node)
            total += shares[node]
        return total / len(self.columns)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, x) as (id, probability); rows with equal columns are answered once."""

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.votes(np.stack(x)))) if len(x) else pd.Series([], dtype=object)

        points = rows.select("x").distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism)
        return rows.join(materialize(points.withColumn("probability", probability("x"))), "x").select("id", "probability")


def bin_bounds(points: DataFrame, columns: int, bins: int) -> list[list[float]]:
    """Bounds per column: midpoints of up to ``bins`` distinct values, else values at equal shares of the weight of all rows."""
    cells = points.select(F.posexplode("x").alias("f", "v"), (F.col("w") * F.col("n")).alias("w"))
    values = materialize(cells.groupBy("f", "v").agg(F.sum("w").alias("w")))
    sums = {r["f"]: (r["n"], r["w"]) for r in values.groupBy("f").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    bounds: list[list[float]] = [[] for _ in range(columns)]
    few = [f for f, (n, _) in sums.items() if n <= bins]
    many = [f for f in sums if f not in few]
    own: dict[int, list[float]] = {}
    for r in values.filter(F.col("f").isin(few)).collect():  # at most ``bins`` values for each of these columns
        own.setdefault(r["f"], []).append(r["v"])
    for f, found in own.items():
        bounds[f] = [(a + b) / 2 for a, b in pairwise(sorted(found))]
    if many:
        # Each column's share of its weight; a value that passes a multiple of 1 / bins ends a bin.
        total = F.element_at(F.create_map(*[F.lit(x) for f in many for x in (f, float(sums[f][1]))]), F.col("f"))
        shares = values.filter(F.col("f").isin(many)).withColumn("w", F.col("w") / total)
        start = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(sorted(many)) for x in (f, float(i))]), F.col("f"))
        placed = running_totals(shares, [F.col("f"), F.col("v")], {"upto": "w"}).withColumn("upto", F.col("upto") - start)
        step = lambda share: F.floor(share * bins + 1e-6)
        ends = placed.filter((step(F.col("upto")) > step(F.col("upto") - F.col("w"))) & (F.col("upto") < 1 - 1e-9))
        for r in ends.select("f", "v").collect():  # at most ``bins`` per column
            bounds[r["f"]].append(r["v"])
    return [sorted(b) for b in bounds]


def fit(train: DataFrame, classes: int, trees: int = TREES, depth: int = DEPTH, seed: int = 42, bins: int = BINS) -> Forest | None:
    """A forest learnt from ``train`` (x, y, w, n): numbers without nulls, class from 0, weight above 0, and how many such rows. None without rows."""
    rows = train.select("x", F.col("y").cast("int").alias("y"), F.col("w").cast("double").alias("w"), "n")
    points = materialize(rows.groupBy("x", "y", "w").agg(F.sum("n").alias("n")))
    total, size = points.agg(F.count("*"), F.max(F.size("x"))).first()
    if not total:
        return None
    bounds = bin_bounds(points, size, bins)
    units = _units(points, bounds, trees, ceil(total / BLOCK))
    most = max(map(len, bounds)) + 1
    nodes, tried = 2 ** (depth + 1) - 1, ceil(sqrt(size)) if trees > 1 else size
    columns, bin_cuts, sums = np.full((trees, nodes), -1), np.zeros((trees, nodes), dtype=int), np.zeros((trees, nodes, classes))
    for level in range(depth):
        first = 2**level - 1
        among = np.array([[np.random.default_rng([seed, t, i]).permutation(size)[:tried] for i in range(first, 2 * first + 1)] for t in range(trees)])
        parts = units.mapInPandas(_pass(columns, bin_cuts, among, level, most, classes, seed), "tree int, cells array<double>")
        added = parts.groupBy("tree").agg(Summarizer.sum(array_to_vector("cells")).alias("cells"))
        found = _best_cuts(added.select("tree", vector_to_array("cells").alias("cells")), tried, most, classes).collect()
        for r in found:
            t, node = r["tree"], first + r["node"]
            if not level:
                sums[t, 0] = r["total"]
            if r["place"] is not None:
                columns[t, node], bin_cuts[t, node] = among[t, r["node"], r["place"]], r["bin"]
                sums[t, 2 * node + 1], sums[t, 2 * node + 2] = r["left"], r["right"]
        if all(r["place"] is None for r in found):
            break
    return _finished(columns, bin_cuts, sums, bounds)


def _units(points: DataFrame, bounds: list[list[float]], trees: int, groups: int) -> DataFrame:
    """Stored units of work: some points, binned, and the trees to grow on them; trees are shared out where points are few."""

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, y, w, n = np.stack(part["x"]), part["y"].to_numpy(np.int32), part["w"].to_numpy(float), part["n"].to_numpy(np.int64)
        order = np.lexsort((w, y, *x.T))  # so that draws do not depend on how the points arrive
        binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]]} | {c: [v[order].tobytes()] for c, v in (("bins", binned), ("y", y), ("w", w), ("n", n))})

    keyed = points.withColumn("block", F.pmod(F.xxhash64("x", "y"), F.lit(groups)).cast("int"))
    blocks = keyed.groupBy("block").applyInPandas(packed, "block int, bins binary, y binary, w binary, n binary")
    tasks = points.sparkSession.sparkContext.defaultParallelism
    some = ceil(trees / min(trees, ceil(2 * tasks / groups)))
    shared = [list(range(t, min(t + some, trees))) for t in range(0, trees, some)]
    return materialize(blocks.withColumn("trees", F.explode(F.lit(shared))).repartition(min(groups * len(shared), 4 * tasks)))


def _pass(columns: np.ndarray, bin_cuts: np.ndarray, among: np.ndarray, level: int, most: int, classes: int, seed: int):
    """Sums the drawn weights of a level by (node, tried column, bin, class) per tree."""
    first, size, tried = 2**level - 1, columns.shape[1], among.shape[2]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for unit in (u for frame in frames for u in frame.itertuples()):
            y, w, n = np.frombuffer(unit.y, np.int32), np.frombuffer(unit.w), np.frombuffer(unit.n, np.int64)
            bins = np.frombuffer(unit.bins, np.uint8).reshape(len(y), -1)
            for t in map(int, unit.trees):
                weight = np.random.default_rng([seed, size, t, unit.block]).poisson(n) * w
                node, rows = np.zeros(len(y), dtype=np.int64), np.arange(len(y))
                for _ in range(level):
                    right = bins[rows, columns[t, node]] > bin_cuts[t, node]
                    node = np.where(columns[t, node] >= 0, 2 * node + 1 + right, node)
                live = np.flatnonzero((node >= first) & (weight > 0))
                at, own = node[live] - first, bins[live]
                cells = np.empty((first + 1, tried, most, classes))
                for j in range(tried):
                    index = (at * most + own[rows[: len(live)], among[t, at, j]]) * classes + y[live]
                    cells[:, j] = np.bincount(index, weights=weight[live], minlength=cells[:, j].size).reshape(cells[:, j].shape)
                sums[t] = sums[t] + cells if t in sums else cells
        if sums:
            yield pd.DataFrame({"tree": list(sums), "cells": [v.ravel() for v in sums.values()]})

    return run


def _best_cuts(added: DataFrame, tried: int, most: int, classes: int) -> DataFrame:
    """The best cut of each node that has rows, with the class weights of the node and its sides; null where no cut is a gain."""

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, cells in ((t, c) for frame in frames for t, c in zip(frame["tree"], frame["cells"], strict=True)):
            cells = np.asarray(cells).reshape(-1, tried, most, classes)
            left = cells.cumsum(axis=2)[:, :, :-1]
            right = cells[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]
            total = cells[:, 0].sum(axis=1)
            rows = []
            for node in np.flatnonzero(total.sum(axis=1) > 0):
                l, r = left[node].reshape(-1, classes), right[node].reshape(-1, classes)
                fits = np.flatnonzero((l.sum(axis=1) > 0) & (r.sum(axis=1) > 0))
                own, best = (total[node] ** 2).sum() / total[node].sum(), None
                if len(fits):
                    purity = (l[fits] ** 2).sum(axis=1) / l[fits].sum(axis=1) + (r[fits] ** 2).sum(axis=1) / r[fits].sum(axis=1)
                    best = fits[np.argmax(purity)] if purity.max() > own * (1 + 1e-12) else None
                sides = (None, None, None, None) if best is None else (int(best) // (most - 1), int(best) % (most - 1), l[best], r[best])
                rows.append((t, int(node), total[node], *sides))
            made = pd.DataFrame(rows, columns=["tree", "node", "total", "place", "bin", "left", "right"])
            yield made.astype({"place": "Int32", "bin": "Int32"})

    return added.mapInPandas(
        chosen, "tree int, node int, total array<double>, place int, bin int, left array<double>, right array<double>"
    )


def _finished(columns: np.ndarray, bin_cuts: np.ndarray, sums: np.ndarray, bounds: list[list[float]]) -> Forest:
    """Sibling leaves of one prediction become one leaf."""
    for node in reversed(range(columns.shape[1] // 2)):
        left, right = 2 * node + 1, 2 * node + 2
        leaves = (columns[:, node] >= 0) & (columns[:, left] < 0) & (columns[:, right] < 0)
        columns[leaves & (sums[:, left].argmax(axis=1) == sums[:, right].argmax(axis=1)), node] = -1
    cuts = np.zeros(columns.shape)
    for t, node in np.argwhere(columns >= 0):
        cuts[t, node] = bounds[columns[t, node]][bin_cuts[t, node]]
    total = sums.sum(axis=2, keepdims=True)
    return Forest(columns, cuts, np.divide(sums, total, out=np.zeros_like(sums), where=total > 0))
