"""Histogram boosting with a softmax loss: binned columns, one tree per class and round, grown leaf by leaf.

A pass over the rows adds gradients and hessians up by (node, column, bin), for all nodes
that are asked for at once; only these sums, whose number does not depend on the rows,
reach the driver. Trees grow best leaf first. A pass also asks for the children of splits
that will probably be made, so a tree takes about as many passes as it is deep; what is
chosen in the end is the exact best-first order.

Sums are whole numbers (gradients times ``SCALE``), so partitioning, retries and the size
of the data never change a tree. Rows with equal columns and class have equal gradients and
are kept as one point with their number. Training data of at most ``local_rows`` points run
the same loop inside one task. Missing values (null, NaN) have a bin of their own and go to the
side where they gain more, or with the larger side where the node has none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.session import discard, materialize

ROUNDS, RATE, LEAVES, MIN_LEAF = 250, 0.08, 15, 20
BINS = 255  # and one more for missing values
MISSING = BINS
SCALE = float(1 << 24)
MIN_HESSIAN = 1e-3
# A round on this many points takes about as long in one task as the several jobs of a round by passes.
LOCAL_ROWS = 200_000
# From this many rows on, a tenth is held out and training stops when its loss has not fallen for PATIENCE rounds.
STOP_FROM, PATIENCE, TOLERANCE = 10_000, 10, 1e-7
# Rounds between two stored tables of raw scores.
STORE_EVERY = 10

Node = tuple[int, str]  # class, path from the root as a string of L and R


@dataclass(frozen=True)
class Split:
    """A node with its sums and its best cut; ``column`` is None where it cannot be cut."""

    n: int
    gradient: float
    hessian: float
    gain: float = 0.0
    column: int | None = None
    bin: int = 0
    missing_left: bool = False
    left: tuple[int, float, float] = (0, 0.0, 0.0)


@dataclass(frozen=True)
class Tree:
    splits: dict[str, tuple[int, int, bool]]
    values: dict[str, float]


@dataclass(frozen=True)
class Booster:
    """Bin bounds per column, starting scores per class, and the trees of each round."""

    bounds: list[list[float]]
    base: list[float]
    rounds: list[list[Tree]]
    gains: list[list[dict[str, float]]]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, x) as (id, probability); ``x`` may hold nulls."""
        bounds, base, trees = self.bounds, np.array(self.base), self.rounds

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in filter(len, frames):
                bins = binned(part["x"], bounds)
                yield pd.DataFrame({"id": part["id"], "probability": list(softmax(added(bins, np.tile(base, (len(part), 1)), trees)))})

        return rows.select(F.col("id").cast("bigint").alias("id"), "x").mapInPandas(score, "id bigint, probability array<double>")

    def split_table(self, round_: int = 0) -> list[tuple[int, str, int, float, float]]:
        """(class, path, column, cut, gain) of every split of a round."""
        return [
            (k, path, f, self.bounds[f][b] if b < len(self.bounds[f]) else float("inf"), self.gains[round_][k][path])
            for k, tree in enumerate(self.rounds[round_])
            for path, (f, b, _) in sorted(tree.splits.items())
        ]


# --- helpers on arrays --------------------------------------------------------------------


def softmax(raw: np.ndarray) -> np.ndarray:
    shares = np.exp(raw - raw.max(axis=1, keepdims=True))
    return shares / shares.sum(axis=1, keepdims=True)


def binned(x: pd.Series, bounds: list[list[float]]) -> np.ndarray:
    """Bin per row and column: the first bound that is not below the value."""
    values = np.array([[np.nan if v is None else v for v in row] for row in x], dtype=float).reshape(len(x), len(bounds))
    bins = np.empty(values.shape, dtype=np.uint8)
    for f, limits in enumerate(bounds):
        bins[:, f] = np.where(np.isnan(values[:, f]), MISSING, np.searchsorted(limits, values[:, f], side="left"))
    return bins


def goes_left(bins: np.ndarray, rows: np.ndarray, column: int, cut: int, missing_left: bool) -> np.ndarray:
    own = bins[rows, column]
    return np.where(own == MISSING, missing_left, own <= cut)


def added(bins: np.ndarray, raw: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """Raw scores after some more rounds."""
    raw = raw.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            todo = [("", np.arange(len(bins)))]
            while todo:
                path, rows = todo.pop()
                if path in tree.values:
                    raw[rows, k] += tree.values[path]
                elif len(rows):
                    left = goes_left(bins, rows, *tree.splits[path])
                    todo += [(path + "L", rows[left]), (path + "R", rows[~left])]
    return raw


def sums(
    bins: np.ndarray, y: np.ndarray, held: np.ndarray, n: np.ndarray, raw: np.ndarray, splits: dict[Node, Split], wanted: list[Node]
) -> np.ndarray:
    """Gradient, hessian and rows by (wanted node, column, bin), as whole numbers; the last node holds the held-out loss.

    ``n`` is the number of rows of each point.
    """
    columns = bins.shape[1]
    p = softmax(raw)
    result = np.zeros((len(wanted) + 1, 3, columns * (BINS + 1)), dtype=np.int64)
    place = bins.astype(np.int64) + np.arange(columns) * (BINS + 1)
    learn = np.flatnonzero(~held)
    members: dict[Node, np.ndarray] = {}

    def rows_of(k: int, path: str) -> np.ndarray:
        if not path:
            return learn
        if (k, path) not in members:
            above, split = rows_of(k, path[:-1]), splits[k, path[:-1]]
            left = goes_left(bins, above, split.column, split.bin, split.missing_left)
            members[k, path[:-1] + "L"], members[k, path[:-1] + "R"] = above[left], above[~left]
        return members[k, path]

    for i, (k, path) in enumerate(wanted):
        rows = rows_of(k, path)
        gradient, hessian = p[rows, k] - (y[rows] == k), p[rows, k] * (1 - p[rows, k])
        at = place[rows].ravel()
        for j, values in enumerate((np.rint(gradient * SCALE), np.rint(hessian * SCALE))):
            result[i, j] = np.bincount(at, weights=np.repeat(values * n[rows], columns), minlength=result.shape[2])
        result[i, 2] = np.bincount(at, weights=np.repeat(n[rows], columns), minlength=result.shape[2])
    loss = -np.log(np.maximum(p[held, y[held]], 1e-300))
    result[-1, 0, 0], result[-1, 2, 0] = int((np.rint(loss * SCALE) * n[held]).sum()), int(n[held].sum())
    return result


def best_split(table: np.ndarray, columns: int, min_leaf: int) -> Split:
    """The cut with the greatest gain; the first column, then the lowest bin, then missing to the right, win ties."""
    g, h, n = table.reshape(3, columns, BINS + 1)
    total_n, total_g, total_h = int(n[0].sum()), g[0].sum() / SCALE, h[0].sum() / SCALE
    node = Split(total_n, total_g, total_h)
    if total_n < 2 * min_leaf or total_h < 2 * MIN_HESSIAN:
        return node
    gains = np.full((columns, BINS, 2), -np.inf)
    lefts = []
    for side in (0, 1):
        gl, hl, nl = (np.cumsum(v[:, :BINS], axis=1) + side * v[:, BINS:] for v in (g, h, n))
        lefts.append((nl, gl / SCALE, hl / SCALE))
        nl, gl, hl = lefts[-1]
        fits = (nl >= min_leaf) & (total_n - nl >= min_leaf) & (hl >= MIN_HESSIAN) & (total_h - hl >= MIN_HESSIAN)
        gr, hr = total_g - gl[fits], total_h - hl[fits]
        gains[:, :, side][fits] = gl[fits] ** 2 / hl[fits] + gr**2 / hr - total_g**2 / total_h
    f, b, side = np.unravel_index(int(np.argmax(gains)), gains.shape)
    if not gains[f, b, side] > 1e-12:
        return node
    nl, gl, hl = (float(v[f, b]) for v in lefts[side])
    missing_left = bool(side) if n[f, MISSING] else nl > total_n - nl
    return Split(total_n, total_g, total_h, float(gains[f, b, side]), int(f), int(b), missing_left, (int(nl), gl, hl))


# --- growth -----------------------------------------------------------------------------


def chosen_splits(known: dict[Node, Split], k: int, leaves: int) -> tuple[list[str], list[Node]]:
    """Splits of class ``k`` in best-first order, and the nodes that must be known before the order is certain."""
    heap, chosen, unknown = [], [], []

    def reach(path: str) -> None:
        split = known.get((k, path))
        if split is None:
            unknown.append((k, path))
        elif split.column is not None:
            heappush(heap, (-split.gain, len(path), path))

    reach("")
    while heap and len(chosen) < leaves - 1:
        path = heappop(heap)[2]
        chosen.append(path)
        if len(chosen) < leaves - 1:
            reach(path + "L")
            reach(path + "R")
    return chosen, unknown


def grown(evaluate: Callable, classes: int, columns: int, rate: float, leaves: int, min_leaf: int):
    """Trees of one round with their gains, and the held-out (loss, rows) before it."""
    known: dict[Node, Split] = {}
    wanted = [(k, "") for k in range(classes)]
    held = None
    while wanted:
        tables = evaluate(known, wanted)
        held = held or (int(tables[-1, 0, 0]) / SCALE, int(tables[-1, 2, 0]))
        known |= {node: best_split(table, columns, min_leaf) for node, table in zip(wanted, tables[:-1], strict=True)}
        orders = [chosen_splits(known, k, leaves) for k in range(classes)]
        wanted = [node for _, unknown in orders for node in unknown]
    trees, gains = [], []
    for k, (chosen, _) in enumerate(orders):
        root = known[k, ""]
        ends = {"": (root.n, root.gradient, root.hessian)}
        for path in chosen:
            s, (n, g, h) = known[k, path], ends.pop(path)
            ends[path + "L"], ends[path + "R"] = s.left, (n - s.left[0], g - s.left[1], h - s.left[2])
        splits = {p: (known[k, p].column, known[k, p].bin, known[k, p].missing_left) for p in chosen}
        trees.append(Tree(splits, {p: -rate * g / h if h > 0 else 0.0 for p, (_, g, h) in ends.items()}))
        gains.append({p: known[k, p].gain for p in chosen})
    return trees, gains, held


def boosted(evaluator: Callable, advance: Callable, classes: int, columns: int, rounds: int, rate: float, leaves: int, min_leaf: int):
    """All rounds with their gains. ``evaluator(trees)`` gives the sums after ``trees``; ``advance`` is told each new round."""
    trees: list[list[Tree]] = []
    gains, losses = [], []
    for _ in range(rounds):
        made, gain, (loss, rows) = grown(evaluator, classes, columns, rate, leaves, min_leaf)
        if rows:
            losses.append(loss / rows)
            if len(losses) > PATIENCE and min(losses[-PATIENCE:]) > losses[-PATIENCE - 1] - TOLERANCE:
                break
        if not any(t.splits for t in made):
            break
        trees.append(made)
        gains.append(gain)
        advance(made)
    return trees, gains


def _dump(trees: list[list[Tree]], gains: list) -> str:
    return json.dumps([[[(t.splits, t.values) for t in made] for made in trees], gains])


def _load(text: str) -> tuple[list[list[Tree]], list]:
    trees, gains = json.loads(text)
    return [[Tree({p: (f, b, bool(m)) for p, (f, b, m) in s.items()}, v) for s, v in made] for made in trees], gains


# --- Spark ------------------------------------------------------------------------------


def bin_bounds(train: DataFrame, columns: int) -> list[list[float]]:
    """Bounds per column: midpoints of up to 255 distinct values, else values at equal shares of the rows."""
    cells = train.select(F.posexplode("x").alias("f", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    distinct = materialize(cells.distinct())
    counts = {r["f"]: r["n"] for r in distinct.groupBy("f").agg(F.count("*").alias("n")).collect()}
    few = [f for f, n in counts.items() if n <= BINS]
    many = [f for f, n in counts.items() if n > BINS]
    bounds: list[list[float]] = [[] for _ in range(columns)]
    values: dict[int, list[float]] = {}
    # At most 255 values for each of these columns.
    for r in distinct.filter(F.col("f").isin(few)).collect():
        values.setdefault(r["f"], []).append(r["v"])
    for f, own in values.items():
        own.sort()
        bounds[f] = [(a + b) / 2 for a, b in zip(own, own[1:])]
    if many:
        at = [i / BINS for i in range(1, BINS)]
        wide = cells.filter(F.col("f").isin(many)).groupBy("f").agg(F.percentile_approx("v", at, 20_000).alias("q"))
        for r in wide.collect():
            bounds[r["f"]] = sorted(set(r["q"]))
    return bounds


def fit(
    train: DataFrame, classes: int, rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES, min_leaf: int = MIN_LEAF,
    local_rows: int = LOCAL_ROWS, stop_from: int = STOP_FROM,
) -> Booster | None:
    """A booster learnt from ``train`` (id, x, y): numbers with nulls, class from 0. None without rows.

    Starting scores are the logarithms of the class shares; classes without rows start far below.
    Above ``stop_from`` rows a tenth, chosen by a hash of the id, is held out to stop early.
    """
    rows = materialize(train.select(F.col("id").cast("bigint").alias("id"), "x", F.col("y").cast("int").alias("y")))
    total, columns, *per_class = rows.agg(
        F.count("*"), F.max(F.size("x")), *[F.count_if(F.col("y") == k) for k in range(classes)]
    ).first()
    if not total:
        return None
    bounds = bin_bounds(rows, columns)
    base = [float(np.log(max(n, 1e-9) / total)) for n in per_class]
    held = (F.pmod(F.xxhash64("id"), F.lit(10)) == 0) if total > stop_from else F.lit(False)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in filter(len, frames):
            bins = binned(part["x"], bounds)
            yield pd.DataFrame({"bins": [b.tobytes() for b in bins], "y": part["y"], "held": part["held"], "n": part["n"]})

    # Equal rows are binned once, and summed again, so that also values of one bin are equal; the number of points does not depend on the rows' copies.
    equal = rows.groupBy("x", "y", held.alias("held")).agg(F.count("*").alias("n"))
    binned_rows = equal.mapInPandas(cut, "bins binary, y int, held boolean, n bigint")
    points = materialize(binned_rows.groupBy("bins", "y", "held").agg(F.sum("n").alias("n")))
    state = points.withColumn("raw", F.lit(base))
    sizes = (classes, columns, rounds, rate, leaves, min_leaf)
    trees, gains = _fit_in_task(state, *sizes) if points.count() <= local_rows else _fit_by_passes(materialize(state), *sizes)
    return Booster(bounds, base, trees, gains)


def _arrays(part: pd.DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(part["bins"]), dtype=np.uint8).reshape(len(part), columns)
    return bins, part["y"].to_numpy().astype(int), part["held"].to_numpy().astype(bool), part["n"].to_numpy(), np.stack(part["raw"])


def _fit_in_task(state: DataFrame, classes: int, columns: int, *sizes) -> tuple[list[list[Tree]], list]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        bins, y, held, n, raw = _arrays(part, columns)

        def advance(made: list[Tree]) -> None:
            raw[:] = added(bins, raw, [made])

        found = boosted(lambda known, wanted: sums(bins, y, held, n, raw, known, wanted), advance, classes, columns, *sizes)
        return pd.DataFrame({"trees": [_dump(*found)]})

    # At most local_rows points meet here.
    return _load(state.groupBy().applyInPandas(run, "trees string").first()["trees"])


def _fit_by_passes(state: DataFrame, classes: int, columns: int, *sizes) -> tuple[list[list[Tree]], list]:
    stored, fresh = [state], []  # the table of raw scores, and the rounds since

    def moved(frames: Iterator[pd.DataFrame], rounds: list[list[Tree]]) -> Iterator[pd.DataFrame]:
        for part in filter(len, frames):
            bins, _, _, _, raw = _arrays(part, columns)
            yield part.assign(raw=list(added(bins, raw, rounds)))

    def advance(made: list[Tree]) -> None:
        fresh.append(made)
        if len(fresh) == STORE_EVERY:
            rounds, old = list(fresh), stored.pop()
            stored.append(materialize(old.mapInPandas(lambda frames: moved(frames, rounds), old.schema)))
            fresh.clear()
            discard(old)

    def evaluate(known: dict[Node, Split], wanted: list[Node]) -> np.ndarray:
        rounds = list(fresh)

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = 0
            for part in filter(len, frames):
                bins, y, held, n, raw = _arrays(part, columns)
                found = found + sums(bins, y, held, n, added(bins, raw, rounds), known, wanted)
            if not np.isscalar(found):
                node, cell = np.nonzero((found != 0).any(axis=1))
                yield pd.DataFrame({"node": node, "cell": cell, **{c: found[node, j, cell] for j, c in enumerate("ghn")}})

        parts = stored[0].mapInPandas(partial, "node int, cell int, g bigint, h bigint, n bigint")
        cells = parts.groupBy("node", "cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()
        result = np.zeros((len(wanted) + 1, 3, columns * (BINS + 1)), dtype=np.int64)
        for j, c in enumerate("ghn"):
            result[cells["node"], j, cells["cell"]] = cells[c]
        return result

    return boosted(evaluate, advance, classes, columns, *sizes)
