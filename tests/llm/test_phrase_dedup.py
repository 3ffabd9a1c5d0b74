"""Repeated strings against a brute-force count of every string at every place."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from caregap.llm import phrase_dedup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def brute(texts, length=phrase_dedup.LENGTH):
    """(n_bytes, n_removed, n_spans, kept) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        yield len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, dtype=np.uint8)[~gone])


def result(df, length=phrase_dedup.LENGTH):
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in phrase_dedup.remove_repeats(df, length).collect()), key=repr
    )


def expected(rows, length=phrase_dedup.LENGTH):
    return sorted(((i, *found) for (i, _), found in zip(rows, brute([t for _, t in rows], length), strict=True)), key=repr)


def prose(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(k))) for k in rng.integers(2, 9, n))


def test_planted_passages_and_copies(spark):
    """Passages from just below to well above the length, in other surroundings, at all distances to the edges."""
    rng = np.random.default_rng(12)
    rows = [(i, prose(rng, 80)) for i in range(60)]
    for k, size in enumerate((198, 199, 200, 201, 215, 216, 260, 400, 900)):
        passage = prose(rng, 400)[:size]
        for j in range(2 + k % 3):
            i = (7 * k + 13 * j) % 60
            text = rows[i][1]
            at = int(rng.integers(0, len(text)))
            rows[i] = (i, text[:at] + passage + text[at:])
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(110, rows[4][1].replace("e", "é")), (111, rows[4][1])]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == expected(rows)
    assert sum(r[2] for r in got) > 10_000


def test_low_entropy_texts(spark):
    """One letter, short periods and two letters: triggers tie or lie in regular rows."""
    rng = np.random.default_rng(3)
    two = "".join("ab"[c] for c in rng.integers(0, 2, 700))
    texts = ["a" * 200, "a" * 201, "b" * 200, "ab" * 180, "xyz" * 90 + "q" + "xyz" * 90, two, two[100:420] + "c" * 250, "é" * 130, "d" * 199]
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


@pytest.mark.parametrize("length", [24, 48, 120, 380])
def test_other_lengths(spark, length):
    rng = np.random.default_rng(length)
    parts = [prose(rng, 12) for _ in range(12)]
    rows = [(i, " ".join(parts[j] for j in rng.integers(0, 12, 14))) for i in range(30)]
    assert result(spark.createDataFrame(rows, SCHEMA), length) == expected(rows, length)


def test_lengths_out_of_range_are_refused(spark):
    with pytest.raises(ValueError):
        phrase_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), 12)


def test_edge_cases(spark):
    """Nulls, empty texts, equal rows, different texts under one id or under none."""
    rng = np.random.default_rng(5)
    a, b, c = prose(rng, 90), prose(rng, 90), prose(rng, 90)
    rows = [(1, None), (2, ""), (3, a), (3, a), (4, b), (4, b[:260] + "!"), (None, c), (None, b), (None, None), (5, "x" * 150)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(1, a, 3, "v"), (2, a, 4, "w")], "doc_id int, text string, place int, version string")
    assert [r.n_removed for r in phrase_dedup.remove_repeats(df).collect()] == [len(a), len(a)]


def test_large_group_of_near_copies(spark):
    """600 copies that differ in one place each: a frequent core with as many entries as rows."""
    rng = np.random.default_rng(8)
    text = prose(rng, 160)
    rows = []
    for i in range(600):
        at = int(rng.integers(0, len(text)))
        rows.append((i, text[:at] + f"<{i}>" + text[at + 1 :]))
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(8)) == expected(rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {
        (d.doc_id, n, gone, spans, hashlib.sha256(kept).hexdigest())
        for d, (n, gone, spans, kept) in zip(docs, brute([d.text for d in docs]), strict=True)
    }
    got = queries.QUERIES["op12_suffix_dedup"](spark, SF).collect()
    assert len(got) == len(docs)
    assert {tuple(r) for r in got} == want
    assert sum(r.n_removed for r in got) > 0
