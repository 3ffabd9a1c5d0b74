"""Periodic runs against a brute-force search of all starts and periods."""

import hashlib

import numpy as np
import pytest

from caregap.llm import periodic_runs, queries
from caregap.llm.periodic_runs import MIN_LENGTH

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=MIN_LENGTH):
    """(start, length, period) of all runs: each stretch that keeps a period, under its smallest one."""
    n, smallest = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                smallest.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(spark, rows):
    out = periodic_runs.collapse_runs(spark.createDataFrame(rows, "doc_id bigint, text string"))
    return [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]


def expected(rows):
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute_runs(words)
        yield doc_id, len(words), runs, collapsed(words, runs)


def by_id(rows):
    return sorted(rows, key=repr)


def test_random_texts_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        letters = int(rng.integers(1, 5))
        words = [f"w{x}" for x in rng.integers(0, letters, int(rng.integers(0, 120)))]
        if words and i % 3 == 0:  # a period inside, up to half of the text
            a = int(rng.integers(0, len(words)))
            p = 1 + int(rng.integers(0, max(1, (len(words) - a) // 2)))
            words = [words[j if j < a else a + (j - a) % p] for j in range(len(words))]
        rows.append((i, " ".join(words)))
    assert by_id(found(spark, rows)) == by_id(expected(rows))


def test_periods_inside_periods(spark):
    block = "a b a b a b a b a b a b a b c".split()
    texts = ["a " * 400, " ".join(block * 9), "a b " * 30 + "b a " * 30, "x " + "a a b " * 40 + "a a c " + "a a b " * 40, "ab " * 11, "ab " * 12]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert by_id(found(spark, rows)) == by_id(expected(rows))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "z " * 20), (4, "é x " * 13), (4, "é x " * 13), (5, "one"), (6, " ".join("ab" * 20))]
    assert by_id(found(spark, rows)) == by_id(expected(rows))
    assert found(spark, []) == []


def test_other_columns_and_neighbouring_documents(spark):
    """A run never reaches into the next row; columns with the names of the result are not read."""
    half = "p q r s t u "
    df = spark.createDataFrame([(1, half, 9, "x"), (2, half, 9, "x")], "doc_id bigint, text string, runs int, collapsed string").coalesce(1)
    assert [len(r.runs) for r in periodic_runs.collapse_runs(df).collect()] == [0, 0]


def test_long_text_is_not_quadratic():
    """120,000 equal words, and a long period: pairs stay within twice the words of each class of lags."""
    n = 120_000
    start, stop, period = periodic_runs.find_runs(np.zeros(n, dtype=np.int64), MIN_LENGTH, n)
    assert (start.tolist(), stop.tolist(), period.tolist()) == ([0], [n], [1])
    names = np.random.default_rng(1).integers(0, 3, 50_000)
    start, stop, period = periodic_runs.find_runs(np.tile(names, 2), MIN_LENGTH, 100_000)
    assert (0, 100_000, 50_000) in zip(start.tolist(), stop.tolist(), period.tolist(), strict=True)


def test_too_short_runs_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(5, dtype=np.int64), 5, 5)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    planted = 0
    for r in got:
        words = [w.decode() for w in queries._plant_period(r.doc_id, (docs[r.doc_id] or "").encode().split())]
        if len(words) > 1200:
            continue  # brute force is quadratic
        runs = brute_runs(words)
        planted += bool(runs)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == want
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5
