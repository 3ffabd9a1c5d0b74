"""Stretches of text that repeat themselves with a period, found by seeds on diagonals.

A run with period q and at least ``min_length`` words equals itself q words later
over an overlap of at least max(min_length - q, q) words: that is the k-gram length
each class of lags guarantees. Lags of 2h to 4h words guarantee 2h words, and such
an overlap holds a whole aligned block of h words. So only aligned blocks are seeds,
each is paired with the equal h-grams of its own document 2h to 4h words later, and
all pairs of one class are at most twice the words, even where all words are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts, texts_only

MIN_LENGTH = 12
# Seed pairs held at once.
PAIRS = 1 << 21
RUNS_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def collapse_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every document.

    A run is a stretch of words with smallest period q and max(``min_length``, 2q)
    words or more that no neighbouring word extends. ``runs`` are in order of start,
    then period. ``collapsed`` keeps the words that no run holds behind its first q
    words, joined by one space. ``rewrite`` may change the words of a document first.

    Defined cases: a null or empty text has no words and an empty ``collapsed``; rows
    with one id are documents of their own; a null id stays null; other columns are
    not read; an empty table gives no rows. Memory follows the longest text.
    """

    def work(ids: pa.Array, texts: list[bytes | None]) -> Iterator[dict]:
        ids = ids.to_pylist()
        words = [(t or b"").split() for t in texts]  # white space is exactly 0x20 and 0x09 to 0x0D
        if rewrite:
            words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        starts, stops, periods = find_runs(_names(words, sizes), min_length, int(sizes.max(initial=0)))
        owner = np.searchsorted(ends, starts, side="right")
        gone = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
        np.add.at(gone, starts + periods, 1)
        np.add.at(gone, stops, -1)
        stays = np.cumsum(gone[:-1]) == 0
        runs: list[list[dict]] = [[] for _ in words]
        for d, s, e, q in zip(owner.tolist(), starts.tolist(), stops.tolist(), periods.tolist(), strict=True):
            runs[d].append({"start": s - int(ends[d] - sizes[d]), "length": e - s, "period": q})
        yield {
            "doc_id": ids,
            "n_words": sizes,
            "runs": runs,
            "collapsed": [
                b" ".join(compress(w, stays[e - len(w) : e]) if r else w).decode()
                for w, e, r in zip(words, ends.tolist(), runs, strict=True)
            ],
        }

    return map_texts(texts_only(docs), work, RUNS_SCHEMA)


def _names(words: list[list[bytes]], sizes: np.ndarray) -> np.ndarray:
    """One number per word, alike only for equal words of the same document."""
    flat = pa.array([w for doc in words for w in doc], pa.binary()).dictionary_encode()
    kinds = max(1, len(flat.dictionary))
    doc = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    return doc * kinds + flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def find_runs(names: np.ndarray, min_length: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs in a row of numbers; no run is longer than ``longest``.

    ``tables[t]`` names the 2^t words at each position by doubling; what stands once
    has a negative name of its own. Names are exact, so nothing is verified again.
    """
    if min_length < 6:
        raise ValueError("an overlap must hold an aligned pair of words: min_length is at least 6")
    tables = [_named(np.arange(len(names)), names, len(names))]
    found = [np.empty((3, 0), dtype=np.int64)]
    size, first_lag = 2, 1
    while first_lag * 2 <= longest:
        tables.append(_doubled(tables[-1], size // 2))
        if not (tables[-1] >= 0).any():
            break
        lag, left, last = _chains(tables[-1], size, first_lag, max(8, 4 * size))
        start, stop = _extended(tables, lag, left, last + size)
        long = stop - start >= np.maximum(min_length - lag, lag)
        found.append(np.stack([start[long], stop[long] + lag[long], lag[long]]))
        # From blocks of two words (lags below 8) to four (8 to 15), then doubling both.
        first_lag = max(8, 4 * size)
        size = first_lag // 2
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    # Multiples of a period give the same stretch again: the smallest lag is its period.
    new = np.ones(every.shape[1], dtype=bool)
    new[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
    start, stop, period = every[:, new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _named(places: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Numbers from 0 for the keys that stand more than once, a negative one of its own for every other position."""
    table = -1 - np.arange(n, dtype=np.int64)
    if len(places):
        _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count[name] > 1
        table[places[again]] = name[again]
    return table


def _doubled(table: np.ndarray, size: int) -> np.ndarray:
    """Names of twice ``size`` words from the names of ``size`` words."""
    n = len(table)
    places = np.flatnonzero((table[: max(0, n - size)] >= 0) & (table[size:] >= 0))
    return _named(places, table[places] * (n + 1) + table[places + size], n)


def _chains(table: np.ndarray, size: int, first_lag: int, end_lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, first block, last block) of the rows of neighbouring aligned blocks that match at one lag.

    The row is what a table of the furthest place covered on each lag leaves to extend:
    a block behind a matching block of its lag is covered by that block's extension.
    """
    n = len(table)
    places = np.flatnonzero(table >= 0)
    index = np.sort(table[places] * (n + 1) + places)
    blocks = places[places % size == 0]
    base = table[blocks] * (n + 1)
    low = np.searchsorted(index, base + np.minimum(blocks + first_lag, n))
    count = np.searchsorted(index, base + np.minimum(blocks + end_lag, n)) - low
    parts = [np.empty((3, 0), dtype=np.int64)]
    cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()) + PAIRS, PAIRS)) + 1
    for a, b in pairwise([0, *cuts.tolist()]):
        c = count[a:b]
        seed = np.repeat(blocks[a:b], c)
        entry = np.arange(len(seed)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[a:b], c)
        lag = index[entry] % (n + 1) - seed
        parts.append(_joined(np.stack([lag, seed, seed]), size))
    return tuple(_joined(np.concatenate(parts, axis=1), size))


def _joined(rows: np.ndarray, size: int) -> np.ndarray:
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    opens = np.ones(rows.shape[1], dtype=bool)
    opens[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] - rows[2, :-1] > size)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], rows.shape[1])[: len(first)] - 1
    return np.stack([rows[0, first], rows[1, first], rows[2, last]])


def _extended(tables: list[np.ndarray], lag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words equal those ``lag`` later, to both sides; less than a block is left on either."""
    n = len(tables[0])
    start, stop = start.copy(), stop.copy()
    for t in range(len(tables) - 2, -1, -1):
        step, table = 1 << t, tables[t]
        fits = start >= step
        at = np.where(fits, start - step, 0)
        start -= step * (fits & (table[at] == table[np.minimum(at + lag, n - 1)]))
        fits = stop + lag + step <= n
        at = np.where(fits, stop, 0)
        stop += step * (fits & (table[at] == table[np.minimum(at + lag, n - 1)]))
    return start, stop


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of ``collapse_runs``; ties of length go to the smallest start, then period."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.s").alias("start"),
        length.alias("length"),
        F.col("best.p").alias("period"),
        F.expr("CAST((-best.n * 1000) DIV best.p AS BIGINT)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
