"""Extremely randomised trees without a depth limit: random cuts per node, the best of a few by weighted Gini.

Rows carry the path of their node in each tree. A node of more than ``local_rows`` rows
is split by Spark: one aggregation for the ranges of its columns, one for the class
weights left of its candidate cuts. Smaller nodes are gathered, with the rows that only
ask for a prediction, and grown to their leaves in one task. Trees that still share a
node's rows are grown together, so small data are sent once per block of trees. Every
draw is a digest of seed, tree, path and column, so both ways give the same tree.

Rows with equal columns reach the same leaf of every tree. They are one point: equal
learning rows of a class with their weights added up, equal rows that ask with one answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap.session import materialize

TREES = 400
# A block of trees on this many points takes minutes in one task and some 50 MB; a level by Spark writes them once per tree.
LOCAL_ROWS = 200_000
# Trees of one task while they share all rows.
BLOCK = 10


def _draw(*key: object) -> float:
    return (int(md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def candidates(seed: int, tree: int, path: str, low: np.ndarray, high: np.ndarray) -> list[tuple[int, float]]:
    """(column, cut) of the square root of all columns, drawn among those that differ inside the node."""
    differ = [f for f in range(len(low)) if low[f] < high[f]]
    drawn = sorted(differ, key=lambda f: _draw(seed, tree, path, f))[: max(1, int(len(low) ** 0.5))]
    cuts = [(f, float(low[f] + _draw(seed, tree, path, f, "cut") * (high[f] - low[f]))) for f in drawn]
    return [(f, cut if cut < high[f] else float(low[f])) for f, cut in cuts]


def best_cut(left: np.ndarray, total: np.ndarray) -> int:
    """The candidate with the purest sides; ``left`` holds class weights per candidate. The first one wins ties."""
    right = total - left
    purity = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1)
    return int(np.argmax(purity))


def grow(seed: int, tree: int, path: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, classes: int) -> np.ndarray:
    """Class shares of the leaf that each row of ``asked`` reaches, below one node."""
    shares = np.zeros((len(asked), classes))
    todo = [(path, np.arange(len(y)), np.arange(len(asked)))]
    while todo:
        at, rows, queries = todo.pop()
        if not len(queries):
            continue
        total = np.bincount(y[rows], weights=w[rows], minlength=classes)
        own = x[rows]
        cuts = candidates(seed, tree, at, own.min(axis=0), own.max(axis=0)) if np.count_nonzero(total) > 1 else []
        if not cuts:
            shares[queries] = total / total.sum()
            continue
        sides = [own[:, f] <= cut for f, cut in cuts]
        k = best_cut(np.array([np.bincount(y[rows][s], weights=w[rows][s], minlength=classes) for s in sides]), total)
        f, cut = cuts[k]
        goes = asked[queries, f] <= cut
        todo += [(at + "L", rows[sides[k]], queries[goes]), (at + "R", rows[~sides[k]], queries[~goes])]
    return shares


def class_shares(
    train: DataFrame, asked: DataFrame, classes: int, trees: int = TREES, seed: int = 42, local_rows: int = LOCAL_ROWS
) -> DataFrame:
    """(id, probability) of the rows of ``asked`` (id, x): mean leaf shares over all trees grown on ``train`` (x, y, w).

    ``x`` is an array of numbers without nulls, ``y`` a class from 0, ``w`` a weight above 0.
    Without rows to learn from the result is empty.
    """
    asked = materialize(asked.select("id", "x"))
    points = materialize(asked.select("x").distinct().withColumn("point", F.monotonically_increasing_id()))
    rows = learning_points(train).withColumn("id", F.lit(None).cast("bigint"))
    queries = points.select(F.col("point").alias("id"), "x", F.lit(None).cast("int").alias("y"), F.lit(None).cast("double").alias("w"))
    rows = materialize(rows.unionByName(queries))
    total, first = rows.agg(F.count("*"), F.max(F.when(F.col("y").isNotNull(), F.size("x")))).first()
    if first is None:
        return asked.select("id", F.array().cast("array<double>").alias("probability")).limit(0)
    done, state = [], rows.withColumn("path", F.lit(""))
    if total > local_rows:
        state = materialize(state.withColumn("trees", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("trees", F.array("trees")))
        while True:
            big = _splits(state, first, classes, seed, local_rows)
            if big.isEmpty():
                break
            state, leaves = _routed(state, big)
            done.append(leaves)
    else:
        blocks = [list(range(a, min(a + BLOCK, trees))) for a in range(0, trees, BLOCK)]
        state = state.withColumn("trees", F.explode(F.lit(blocks)))

    def finish(key: tuple, node: pd.DataFrame) -> pd.DataFrame:
        learn, ask = node[node["id"].isna()], node[node["id"].notna()]
        if not len(ask):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "shares": pd.Series(dtype=object)})
        x, y, w = np.stack(learn["x"]), learn["y"].to_numpy().astype(int), learn["w"].to_numpy()
        asked_x = np.stack(ask["x"])
        shares = sum(grow(seed, t, key[1], x, y, w, asked_x, classes) for t in key[0])
        return pd.DataFrame({"id": ask["id"].to_numpy().astype(np.int64), "shares": list(shares)})

    done.append(state.groupBy("trees", "path").applyInPandas(finish, "id bigint, shares array<double>"))
    shares = reduce(DataFrame.unionByName, done)
    means = [F.sum(F.get("shares", F.lit(k))) / trees for k in range(classes)]
    found = shares.groupBy("id").agg(F.array(*means).alias("probability")).withColumnRenamed("id", "point")
    return asked.join(points, "x").join(found, "point").select("id", "probability")


def learning_points(train: DataFrame) -> DataFrame:
    """Rows (x, y, w) that are equal as one, with their weights added up."""
    rows = train.select("x", F.col("y").cast("int").alias("y"), F.col("w").cast("double").alias("w"))
    return rows.groupBy("x", "y", "w").agg(F.count("*").alias("_n")).select("x", "y", (F.col("w") * F.col("_n")).alias("w"))


def root_cuts(train: DataFrame, classes: int, trees: int = TREES, seed: int = 42) -> DataFrame:
    """(tree, first_column, cut) of the root of each tree, null where the rows cannot be cut."""
    train = materialize(train.select("x", "y", "w"))
    size = train.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return train.sparkSession.createDataFrame([], "tree int, first_column int, cut double")
    # All trees have the same root, so its ranges are taken once.
    root = train.agg(*_ranges(size, classes)).filter("n > 0").withColumn("path", F.lit(""))
    nodes = root.withColumn("trees", F.explode(F.lit([[t] for t in range(trees)])))
    cuts = _drawn(nodes, seed)
    splits = _chosen(train.filter(F.col("y").isNotNull()).crossJoin(F.broadcast(cuts)), cuts, size, classes)
    return splits.select(F.get("trees", F.lit(0)).alias("tree"), F.col("column").alias("first_column"), "cut")


def _splits(state: DataFrame, columns: int, classes: int, seed: int, local_rows: int) -> DataFrame:
    """The chosen cut of every node with more than ``local_rows`` rows, or its class shares if it cannot be cut."""
    nodes = state.groupBy("trees", "path").agg(*_ranges(columns, classes)).filter(F.col("n") > local_rows)
    cuts = _drawn(nodes, seed)
    return _chosen(state.filter(F.col("y").isNotNull()).join(cuts, ["trees", "path"]), cuts, columns, classes)


def _ranges(columns: int, classes: int) -> list[Column]:
    """Rows of a node, the ends of its columns and its class weights."""
    learns = F.col("y").isNotNull()
    value = [F.when(learns, F.get("x", F.lit(f))) for f in range(columns)]
    weight = [F.coalesce(F.sum(F.when(F.col("y") == k, F.col("w"))), F.lit(0.0)) for k in range(classes)]
    return [
        F.count("*").alias("n"), F.array(*[F.min(v) for v in value]).alias("low"), F.array(*[F.max(v) for v in value]).alias("high"),
        F.array(*weight).alias("total"),
    ]


def _drawn(nodes: DataFrame, seed: int) -> DataFrame:
    """The candidate cuts of each node, stored."""

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for node in filter(len, frames):
            cuts = [
                candidates(seed, t[0], p, np.array(lo), np.array(hi)) if np.count_nonzero(w) > 1 else []
                for t, p, lo, hi, w in zip(node["trees"], node["path"], node["low"], node["high"], node["total"], strict=True)
            ]
            yield node[["trees", "path", "total"]].assign(columns=[[f for f, _ in c] for c in cuts], cuts=[[v for _, v in c] for c in cuts])

    return materialize(nodes.mapInPandas(drawn, "trees array<int>, path string, total array<double>, columns array<int>, cuts array<double>"))


def _chosen(sides: DataFrame, cuts: DataFrame, columns: int, classes: int) -> DataFrame:
    """The best of the candidate cuts of each node; ``sides`` holds the learning rows of each node with its cuts."""
    most = max(1, int(columns**0.5))
    left = [
        F.coalesce(F.sum(F.when((F.col("y") == k) & (F.get("x", F.get("columns", F.lit(c))) <= F.get("cuts", F.lit(c))), F.col("w"))), F.lit(0.0))
        for c in range(most)
        for k in range(classes)
    ]
    # Grouped by the node alone: the cuts of a node would be a long key of every row.
    summed = sides.groupBy("trees", "path").agg(F.array(*left).alias("left")).join(cuts, ["trees", "path"])

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for node in filter(len, frames):
            best = [
                best_cut(np.array(sums).reshape(most, classes)[: len(cuts)], np.array(total)) if len(cuts) else None
                for sums, cuts, total in zip(node["left"], node["cuts"], node["total"], strict=True)
            ]
            yield node[["trees", "path", "total"]].assign(
                column=pd.array([None if b is None else int(f[b]) for b, f in zip(best, node["columns"], strict=True)], dtype="Int32"),
                cut=pd.array([None if b is None else float(v[b]) for b, v in zip(best, node["cuts"], strict=True)], dtype="Float64"),
            )

    return materialize(summed.mapInPandas(chosen, "trees array<int>, path string, total array<double>, column int, cut double"))


def _routed(state: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows one level further, without those of finished nodes, and the shares of queries in finished nodes."""
    joined = state.join(splits, ["trees", "path"], "left")
    leaf = F.col("total").isNotNull() & F.col("cut").isNull()
    sum_of = F.aggregate("total", F.lit(0.0), lambda a, v: a + v)
    leaves = materialize(joined.filter(leaf & F.col("id").isNotNull()).select("id", F.transform("total", lambda v: v / sum_of).alias("shares")))
    side = F.when(F.get("x", F.col("column")) <= F.col("cut"), "L").otherwise("R")
    moved = joined.filter(~leaf).withColumn("path", F.when(F.col("cut").isNull(), F.col("path")).otherwise(F.concat("path", side)))
    return materialize(moved.select(*state.columns)), leaves
