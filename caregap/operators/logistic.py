"""Penalised logistic regression at its exact optimum, by Newton's method on sums over the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest entry of the gradient at which the fit stops, and the one a report calls optimal.
TOLERANCE = 1e-8
OPTIMAL = 1e-6


@dataclass(frozen=True)
class LogisticFit:
    """Coefficients of standardised features, the intercept last; it is penalised like the others."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    c: float

    def inputs(self) -> list[Column]:
        return [*((F.col(f) - m) / s for f, m, s in zip(self.features, self.mean, self.scale, strict=True)), F.lit(1.0)]

    def decision(self) -> Column:
        return sum(F.lit(b) * x for b, x in zip(self.coefficients, self.inputs(), strict=True))

    def transform(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, 1 / (1 + F.exp(-self.decision())))


def standardised(rows: DataFrame, features: tuple[str, ...]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Mean and population deviation of each column; a constant column is only shifted."""
    row = rows.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    if row[0] is None:
        raise ValueError("a logistic regression needs rows to learn from")
    return tuple(float(x) for x in row[: len(features)]), tuple(float(x) or 1.0 for x in row[len(features) :])


def fit_logistic(rows: DataFrame, features: tuple[str, ...], label: str, weight: str, c: float = 1.0, steps: int = 60) -> LogisticFit:
    """Minimises |b|² / 2 + ``c`` * the weighted log loss; ``rows`` should be stored, each step reads them once.

    The curvature has one row and column per feature, so the driver gets about
    (features²) / 2 sums per step, whatever the number of rows. The loss is strictly
    convex: a gradient of zero is the one optimum. A step that does not lower the loss is halved.
    """
    mean, scale = standardised(rows, features)
    size = len(features) + 1
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    best, value, step = np.zeros(size), math.inf, np.zeros(size)
    trial = best
    for _ in range(steps):
        fit = LogisticFit(features, mean, scale, tuple(map(float, trial)), c)
        names = [f"x{i}" for i in range(size)]
        data = rows.select(*[x.alias(n) for x, n in zip(fit.inputs(), names, strict=True)], F.col(label).cast("double").alias("y"),
                           F.col(weight).alias("w"), fit.decision().alias("z"))
        data = data.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        p, y, w, z = (F.col(n) for n in "pywz")
        data = data.select(*names, (w * (p - y)).alias("g"), (w * p * (1 - p)).alias("h"),
                           (w * (F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z)).alias("loss"))
        sums = data.agg(
            F.sum("loss"), *[F.sum(F.col("g") * F.col(n)) for n in names],
            *[F.sum(F.col("h") * F.col(names[i]) * F.col(names[j])) for i, j in upper],
        ).first()
        total = trial @ trial / 2 + c * sums[0]
        if total > value + 1e-12 * abs(value):
            step = step / 2
            trial = best + step
            continue
        best, value = trial, total
        gradient = best + c * np.array(sums[1 : size + 1])
        if np.abs(gradient).max() <= TOLERANCE:
            return fit
        curve = np.eye(size)
        for (i, j), h in zip(upper, sums[size + 1 :], strict=True):
            curve[i, j] += c * h
            curve[j, i] = curve[i, j]
        step = -np.linalg.solve(curve, gradient)
        trial = best + step
    if np.abs(gradient).max() > OPTIMAL:
        raise RuntimeError(f"the largest gradient is {np.abs(gradient).max()} after {steps} steps")
    return LogisticFit(features, mean, scale, tuple(map(float, best)), c)


def optimality(scored: DataFrame, fit: LogisticFit, label: str, weight: str, probability: str) -> DataFrame:
    """(coefficient, gradient, is_optimal), from the given probabilities of the rows that the fit learned from."""
    residual = F.col(weight) * (F.col(probability) - F.col(label))
    names = [*fit.features, "intercept"]
    sums = scored.agg(*[(F.lit(b) + fit.c * F.sum(residual * x)).alias(n) for n, x, b in zip(names, fit.inputs(), fit.coefficients, strict=True)])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("coefficient"), F.col(n).alias("gradient")) for n in names])).alias("r")).select("r.*")
    return rows.withColumn("is_optimal", F.abs("gradient") < OPTIMAL)
