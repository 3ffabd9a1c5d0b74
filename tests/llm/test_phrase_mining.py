"""Collocations against a brute-force count of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest

from caregap.llm import phrase_mining, queries
from caregap.llm.phrase_mining import collocations

SF = "/root/testdata/sf0.001"
SCHEMA = "lang string, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, min_count, max_words=5):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            of = counts.setdefault(lang, Counter())
            for m in range(1, max_words + 1):
                of.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    result = []
    for lang, of in counts.items():
        often = {p: n for p, n in of.items() if n >= min_count}
        inside = Counter()
        for p, n in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], n)
        scored = []
        for p, a in often.items():
            if len(p) < 2 or inside[p] >= a:
                continue
            score, k = min((1000 * a * totals[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(result)


def found(spark, rows, top, min_count, max_words=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations(df, top, min_count, max_words).collect())


def corpus(seed, n, words):
    """Texts with words of very different frequency, set phrases and marks."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    chance = 1 / np.arange(1, words + 1)
    chance /= chance.sum()
    sets = [" ".join(rng.choice(vocabulary, int(rng.integers(2, 7)))) for _ in range(40)]
    rows = []
    for i in range(n):
        parts = [str(w) for w in rng.choice(vocabulary, 30, p=chance)]
        for _ in range(4):
            parts.insert(int(rng.integers(0, len(parts))), sets[int(rng.integers(0, len(sets)) * rng.random())])
            parts.insert(int(rng.integers(0, len(parts))), str(rng.choice([",", ".", "!", "A", "\t", "É", "\n", "x;y", "\x0b"])))
        rows.append((["en", "de", None][i % 7 % 3], " ".join(parts)))
    return rows


def test_random_corpora_equal_brute_force(spark):
    for seed, top, least in ((1, 5, 4), (2, 40, 3), (3, 100_000, 2)):
        rows = corpus(seed, 240, 400)
        want = brute(rows, top, least)
        assert {r[0] for r in want} == {"en", "de", "und"}
        assert found(spark, rows, top, least) == want


def test_bound_settles_a_language_early(spark, monkeypatch):
    """With few places to fill, the round with all words is never run, and ties at the last place are whole."""
    rows = corpus(5, 300, 400)
    rounds = []
    real = phrase_mining._frontier_phrases
    monkeypatch.setattr(phrase_mining, "_frontier_phrases", lambda *a: rounds.append(1) or real(*a))
    assert found(spark, rows, 3, 3) == brute(rows, 3, 3)
    assert len(rounds) < len(phrase_mining.FRONTIER)


def test_wrong_hits_of_a_full_filter_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "FILTER_BITS", 64)
    rows = corpus(6, 150, 200)
    assert found(spark, rows, 10, 3) == brute(rows, 10, 3)


def test_other_sizes(spark):
    rows = corpus(7, 120, 100)
    for size in (2, 3):
        assert found(spark, rows, 50, 3, size) == brute(rows, 50, 3, size)


def test_edge_cases(spark):
    """Nulls, empty texts, marks alone, repeats that overlap, a long text cut into parts, and large counts."""
    rows = [(None, "a a a a a"), ("und", "a a, a a"), ("en", None), ("en", ""), ("en", " ,.;\t\n"), ("fr", "B b\tB"), ("fr", "b b b")]
    assert found(spark, rows, 10, 2) == brute(rows, 10, 2)
    assert found(spark, [], 10, 2) == []
    df = spark.createDataFrame([("en", "q r q r", 1, 2, "z")], "lang string, text string, n int, score int, phrase string")
    assert [r.phrase for r in collocations(df, 10, 2).collect()] == [r[2] for r in brute([("en", "q r q r")], 10, 2)]


def test_long_text_is_counted_in_parts(monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLICE_BYTES", 8)
    for text in (b"one two,three four five six seven eight nine,ten", b"no mark at all in this one", b",,,,", b"ends with a mark in it,"):
        parts = list(phrase_mining._parts([text, text]))
        assert b"".join(parts) == text + b"," + text
        assert all(p.endswith(b",") for p in parts[:-1])


@pytest.mark.parametrize("a, n, l, r", [(9 * 10**13, 9 * 10**14, 10**14, 3), (123_456_789_012, 987_654_321_098_765, 123_456_789_013, 123_456_789_012)])
def test_scores_are_exact(spark, a, n, l, r):
    phrases = spark.createDataFrame([("en", "u", l), ("en", "v", r), ("en", "u v", a)], "lang string, phrase string, n bigint")
    limits = spark.createDataFrame([("en", n)], "lang string, total bigint")
    row = phrase_mining._scored(phrases, phrases, limits, 1).first()
    assert (row.score, row.l, row.r) == (1000 * a * n // (l * r), l, r)


def test_query_equals_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op13_phrase_mining"](spark, SF).collect()) == brute(rows, 2000, 100)
