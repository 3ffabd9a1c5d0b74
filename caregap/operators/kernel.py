"""Three-class kernel classifier: random Fourier features, one hinge-loss machine per pair of classes, coupled probabilities.

A Gaussian kernel is replaced by ``width`` random features, so a machine is a vector of
fixed length and training is a few passes over the rows. Each pass sums, inside the
tasks, what Newton's step and the duality gap need; only these sums reach the driver
(machines * width² / 2 numbers, whatever the rows). All machines of all folds share a pass.

Rows with equal columns and class are one point with their number. A pass takes the rows of
a class and fold together, for all machines that learn from them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, partial
from hashlib import md5
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap.operators import ml
from caregap.schemas import PRIORITY_LABELS
from caregap.session import materialize

WIDTH = 128
INVERSE_PENALTY = 2.0
FOLDS = 5
# Largest duality gap of a fitted machine as a share of its loss.
GAP = 0.01
# The same for the machines that only give decisions on their held-out fold to the sigmoids.
FOLD_GAP = 0.05
# Lengths of a step that are tried. Where the smoothing has just fallen, few rows bend the loss and a whole step is far too long.
_STEPS = tuple(0.5**k for k in range(24))
# Rows whose features are held at once in a task.
_BLOCK = 2048


def _uniform(*key: object) -> float:
    """A number in (0, 1) from 52 bits of a digest, so that SQL can draw it, too."""
    return (int(md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 16**13


class FourierFeatures(Transformer):
    """Maps an array column to ``width`` features whose inner products approach exp(-gamma |x - y|²)."""

    def __init__(self, size: int, gamma: float, width: int = WIDTH, seed: int = 42, input_col: str = "x", output_col: str = "z"):
        super().__init__()
        self.size, self.gamma, self.width, self.seed = size, gamma, width, seed
        self.input_col, self.output_col = input_col, output_col

    @cached_property
    def directions(self) -> np.ndarray:
        draw = [
            [
                math.sqrt(-2 * math.log(_uniform(self.seed, i, j, "radius"))) * math.cos(2 * math.pi * _uniform(self.seed, i, j, "angle"))
                for j in range(self.width)
            ]
            for i in range(self.size)
        ]
        return math.sqrt(2 * self.gamma) * np.array(draw).reshape(self.size, self.width)

    @cached_property
    def phases(self) -> np.ndarray:
        return np.array([2 * math.pi * _uniform(self.seed, j, "phase") for j in range(self.width)])

    def expand(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / self.width) * np.cos(x @ self.directions + self.phases)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.expand(np.stack(x)))) if len(x) else pd.Series([], dtype=object)

        return dataset.withColumn(self.output_col, mapped(self.input_col))


def scale_gamma(rows: DataFrame, column: str = "x", count: Column | None = None) -> tuple[int, float]:
    """Number of columns and 1 / (columns * variance of all entries); a row stands for ``count`` equal ones."""
    entries, count = F.col(column), F.lit(1) if count is None else count
    total = lambda f: F.sum(count * F.aggregate(F.transform(entries, f), F.lit(0.0), lambda a, v: a + v))
    n, size, first, second = rows.agg(F.sum(count), F.max(F.size(entries)), total(lambda v: v), total(lambda v: v * v)).first()
    if not n:
        raise ValueError("a kernel classifier needs rows to learn from")
    variance = second / (n * size) - (first / (n * size)) ** 2
    return size, 1.0 / (size * variance) if variance > 0 else 1.0


# --- one machine per pair of classes and fold ----------------------------------------------


@dataclass
class Machine:
    """Separates class ``plus`` (+1) from ``minus`` (-1) on all rows outside ``fold``."""

    plus: int
    minus: int
    fold: int | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    smoothing: float = 2.0
    loss: float = math.inf
    gap: float = math.inf

    def learns_from(self, y: int, fold: int) -> bool:
        return y in (self.plus, self.minus) and fold != self.fold


def _slack(machines: list[Machine], y: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slack of each row (of class ``y``) for each machine, and the machines' signs of the class and smoothing."""
    sign = np.where([m.plus == y for m in machines], 1.0, -1.0)
    slack = 1 - sign * (z @ np.stack([m.weights for m in machines], axis=1))
    return slack, sign, np.array([m.smoothing for m in machines])


def _smooth(slack: np.ndarray, smoothing: np.ndarray) -> np.ndarray:
    """The hinge loss with a parabola of width ``smoothing`` at its corner."""
    return np.where(slack < smoothing, np.maximum(slack, 0) ** 2 / (2 * smoothing), slack - smoothing / 2)


def _gram(z: np.ndarray, c: np.ndarray) -> np.ndarray:
    scaled = z * np.sqrt(c)[:, None]
    return scaled.T @ scaled


def _sums(machines: list[Machine], y: int, z: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Per machine: curvature (upper half) and pull of the smoothed loss, its value, the hinge loss, and the two parts of the dual."""
    slack, sign, smoothing = _slack(machines, y, z)
    share = np.clip(slack / smoothing, 0, 1)
    pull = z.T @ (c[:, None] * share * sign)
    ends = np.array([c @ v for v in (_smooth(slack, smoothing), np.maximum(slack, 0), share, share**2)])
    upper, every, found = np.triu_indices(z.shape[1]), None, []
    for k, bent in enumerate(((slack > 0) & (slack < smoothing)).T):
        if 2 * np.count_nonzero(bent) > len(z):  # the other rows are fewer
            every = _gram(z, c) if every is None else every
            curve = every if bent.all() else every - _gram(z[~bent], c[~bent])
        else:
            curve = _gram(z[bent], c[bent])
        found.append(np.concatenate([curve[upper] / smoothing[k], pull[:, k], ends[:, k]]))
    return found


def _along(directions: dict[int, np.ndarray], machines: dict[int, Machine], y: int, z: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Per machine: smoothed loss of the rows at each of ``_STEPS`` in its direction."""
    slack, sign, smoothing = _slack(list(machines.values()), y, z)
    change = sign * (z @ np.stack([directions[k] for k in machines], axis=1))
    return list(np.array([c @ _smooth(slack - t * change, smoothing) for t in _STEPS]).T)


def _total(
    rows: DataFrame, fourier: FourierFeatures, c: float, machines: dict[int, Machine], work: Callable[..., list[np.ndarray]]
) -> dict[int, np.ndarray]:
    """Sums over all rows of the array that ``work`` gives per machine; folded per task, then by Spark."""
    schema = pa.schema([("key", pa.int32()), ("values", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for y, fold, x, bound in _cells(batch):
                own = {k: m for k, m in machines.items() if m.learns_from(y, fold)}
                if own:
                    z = np.hstack([fourier.expand(x), np.ones((len(x), 1))])
                    for k, values in zip(own, work(own, y, z, c * bound), strict=True):
                        sums[k] = sums[k] + values if k in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], schema=schema)

    parts = rows.select("x", "y", "fold", "weight").mapInArrow(run, "key int, values array<double>")
    total = parts.groupBy("key").agg(Summarizer.sum(array_to_vector("values")).alias("total")).collect()
    return {r["key"]: r["total"].toArray() for r in total}


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, fold, columns, weights) of the rows of a class and fold, some at a time."""
    if not batch.num_rows:
        return
    x, y, fold, weight = (batch.column(c) for c in ("x", "y", "fold", "weight"))
    x, y, fold, weight = x.flatten().to_numpy().reshape(len(x), -1), y.to_numpy(), fold.to_numpy(), weight.to_numpy()
    order = np.lexsort((fold, y))
    borders = np.flatnonzero(np.diff(y[order]) | np.diff(fold[order])) + 1
    for cell in np.split(order, borders):
        for start in range(0, len(cell), _BLOCK):
            own = cell[start : start + _BLOCK]
            yield int(y[own[0]]), int(fold[own[0]]), x[own], weight[own]


def fit_machines(rows: DataFrame, fourier: FourierFeatures, machines: list[Machine], c: float, steps: int = 200) -> None:
    """Newton steps on the smoothed hinge loss until each machine's duality gap is within its share of its loss.

    The smoothed loss gives each row a dual weight between 0 and its bound, so the gap
    to the hinge loss itself is known at every step. Smoothing falls once it makes up
    most of that gap. A step is two passes: sums, then the loss at several step lengths;
    weights move only where the smoothed loss falls. ``steps`` only ends a fit that stalls.
    """
    n = fourier.width + 1
    upper = np.triu_indices(n)
    half = len(upper[0])
    for m in machines:
        m.weights = np.zeros(n)
    active = list(range(len(machines)))

    for _ in range(steps):
        directions, values = {}, {}
        found = _total(rows, fourier, c, {k: machines[k] for k in active}, lambda own, *data: _sums(list(own.values()), *data))
        for k in list(active):
            m, sums = machines[k], found.get(k)
            if sums is None:  # no rows at all
                sums = np.zeros(half + n + 4)
            curve, pull = np.zeros((n, n)), sums[half : half + n]
            curve[upper] = curve.T[upper] = sums[:half]
            smooth, hinge, linear, square = sums[half + n :]
            own, dual = m.weights @ m.weights / 2, linear - pull @ pull / 2
            m.loss, m.gap = own + hinge, own + hinge - dual
            if m.gap <= (GAP if m.fold is None else FOLD_GAP) * m.loss:
                active.remove(k)
            elif own + smooth - (dual - m.smoothing * square / 2) <= 0.2 * m.gap:
                m.smoothing /= 4
            else:
                directions[k], values[k] = np.linalg.solve(curve + np.eye(n), pull - m.weights), own + smooth
        if not active:
            return
        found = _total(rows, fourier, c, {k: machines[k] for k in directions}, partial(_along, directions)) if directions else {}
        for k, losses in found.items():
            m, d = machines[k], directions[k]
            moved = [m.weights + t * d for t in _STEPS]
            reached = [w @ w / 2 + loss for w, loss in zip(moved, losses, strict=True)]
            best = int(np.argmin(reached))
            if reached[best] < values[k]:
                m.weights = moved[best]
    raise RuntimeError(f"the duality gap of {len(active)} machines is too wide after {steps} steps")


# --- probabilities --------------------------------------------------------------------------


def fit_sigmoid(
    decisions: DataFrame, decision: str, positive: Column, passes: int = 50, count: Column | None = None
) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a f + b)) by Newton's method on smoothed targets, in JVM sums; a row stands for ``count`` equal ones."""
    count = F.lit(1) if count is None else count
    n_pos, n_neg = (n or 0 for n in decisions.agg(F.sum(F.when(positive, count)), F.sum(F.when(~positive, count))).first())
    high, low = (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2)
    target, f = F.when(positive, high).otherwise(low), F.col(decision)
    point, value, step = np.array([0.0, math.log((n_neg + 1) / (n_pos + 1))]), math.inf, np.zeros(2)
    trial = point
    for _ in range(passes):
        s = F.lit(float(trial[0])) * f + F.lit(float(trial[1]))
        p = 1 / (1 + F.exp(s))
        loss = F.when(s >= 0, target * s + F.log1p(F.exp(-s))).otherwise((target - 1) * s + F.log1p(F.exp(s)))
        g, h = target - p, p * (1 - p)
        total, g_a, g_b, h_aa, h_ab, h_bb = (
            x or 0.0 for x in decisions.agg(*[F.sum(count * x) for x in (loss, g * f, g, h * f * f, h * f, h)]).first()
        )
        if total > value + 1e-12 * abs(value):
            step = step / 2
            trial = point + step
            continue
        point, value = trial, total
        gradient = np.array([g_a, g_b])
        if np.abs(gradient).max() <= 1e-7 * max(1, n_pos + n_neg):
            break
        step = -np.linalg.solve(np.array([[h_aa, h_ab], [h_ab, h_bb]]) + 1e-12 * np.eye(2), gradient)
        trial = point + step
    return float(point[0]), float(point[1])


def coupled(pairwise: np.ndarray) -> np.ndarray:
    """Class probabilities from ``pairwise[:, i, j]`` = P(i | i or j): the least squares of r_ji p_i = r_ij p_j, summing to one."""
    n, k, _ = pairwise.shape
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k] = -pairwise.transpose(0, 2, 1) * pairwise
    for i in range(k):
        others = [j for j in range(k) if j != i]
        system[:, i, i] = (pairwise[:, others, i] ** 2).sum(axis=1)
    system[:, k, :k] = system[:, :k, k] = 1
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1
    p = np.clip(np.linalg.solve(system, right)[:, :k, 0], 0, None)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class KernelModel:
    prepared: Transformer
    fourier: FourierFeatures
    machines: list[Machine]
    sigmoids: list[tuple[float, float]]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with class probabilities (LOW, MEDIUM, HIGH) as the array ``probability``."""
        data = self.prepared.transform(ml.with_priority_columns(rows)).select(*rows.columns, vector_to_array("features").alias("_x"))
        fourier, machines, sigmoids, k = self.fourier, self.machines, self.sigmoids, len(PRIORITY_LABELS)

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            pairwise = np.full((len(x), k, k), 0.5)
            for m, decision, (a, b) in zip(machines, decisions(fourier, machines, np.stack(x)).T, sigmoids, strict=True):
                p = np.clip(1 / (1 + np.exp(np.clip(a * decision + b, -500, 500))), 1e-7, 1 - 1e-7)
                pairwise[:, m.plus, m.minus], pairwise[:, m.minus, m.plus] = p, 1 - p
            return pd.Series(list(coupled(pairwise)))

        return data.withColumn("probability", probability("_x")).drop("_x")


def decisions(fourier: FourierFeatures, machines: list[Machine], x: np.ndarray) -> np.ndarray:
    z = np.hstack([fourier.expand(x), np.ones((len(x), 1))])
    return z @ np.stack([m.weights for m in machines], axis=1)


def fit_kernel(
    rows: DataFrame,
    label_column: str = "disease_priority",
    c: float = INVERSE_PENALTY,
    gamma: float | None = None,
    width: int = WIDTH,
    folds: int = FOLDS,
    seed: int = 42,
) -> KernelModel:
    """Kernel classifier on mixed features with balanced class weights; ``gamma`` None scales by the variance.

    Sigmoids are fitted to the decisions of machines that did not see the row's fold
    (a hash of its features and label, so equal rows share one). A class that does not
    occur gets no weight; the intercept is penalised like every other weight.
    """
    prepared, data = ml.prepared_priority(rows, label_column)
    data = learning_points(prepared, data, folds)
    size, scaled = scale_gamma(data, count=F.col("n"))
    fourier = FourierFeatures(size, scaled if gamma is None else gamma, width, seed)
    pairs = list(combinations(range(len(PRIORITY_LABELS)), 2))
    machines = [Machine(i, j) for i, j in pairs]
    held_out = [[Machine(i, j, fold) for i, j in pairs] for fold in range(folds)]
    fit_machines(data, fourier, [*machines, *chain(*held_out)], c)

    def unseen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                found = decisions(fourier, held_out[fold], np.stack(part["x"]))
                yield pd.DataFrame({"y": part["y"].to_numpy(), "n": part["n"].to_numpy(), "f": list(found)})

    scored = materialize(data.mapInPandas(unseen, "y int, n bigint, f array<double>"))
    sigmoids = [
        fit_sigmoid(scored.filter(F.col("y").isin(i, j)).select("y", "n", F.get("f", F.lit(k)).alias("f")), "f", F.col("y") == i, count=F.col("n"))
        for k, (i, j) in enumerate(pairs)
    ]
    return KernelModel(prepared, fourier, machines, sigmoids)


def learning_points(prepared: Transformer, data: DataFrame, folds: int) -> DataFrame:
    """Labelled rows that are equal as one (x, y, weight, fold, n), with their weights added up; stored, as many files as tasks run at once."""
    columns = [*ml.PRIORITY_NUMERIC, *ml.PRIORITY_CATEGORICAL, "target", "class_weight"]
    equal = prepared.transform(data.groupBy(*columns).agg(F.count("*").alias("n")))
    points = equal.select(
        vector_to_array("features").alias("x"), F.col("target").cast("int").alias("y"), (F.col("class_weight") * F.col("n")).alias("weight"), "n"
    ).withColumn("fold", F.pmod(F.xxhash64("x", "y"), F.lit(folds)).cast("int"))
    tasks = data.sparkSession.sparkContext.defaultParallelism
    return materialize(points.repartition(tasks).sortWithinPartitions("y", "fold"))


def gap_report(spark, machines: list[Machine]) -> DataFrame:
    """One row per pair of classes: loss, duality gap, and whether the gap is within its bound."""
    rows = [(PRIORITY_LABELS[m.plus], PRIORITY_LABELS[m.minus], float(m.loss), float(m.gap), bool(-1e-9 <= m.gap <= GAP * m.loss)) for m in machines]
    return spark.createDataFrame(rows, "plus string, minus string, loss double, gap double, within_bound boolean")
