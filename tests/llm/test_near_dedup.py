"""Components and near duplicates against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest

from caregap.llm import near_dedup
from caregap.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute(rows, percent=near_dedup.PERCENT):
    """doc_id -> (set size, component) from all pairs."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for a, b in {p for ids in by_shingle.values() for p in combinations(sorted(ids), 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    check(near_dedup.near_duplicates(docs).collect(), want)
    assert len({c for _, c in want.values()}) < len(want)


def chains(n, seed):
    """Texts of about 100 words, each a few words away from an earlier one: links, chains and pairs at the limit."""
    rng = np.random.default_rng(seed)
    texts = []
    for k in range(n):
        if k % 12 == 0:
            words = [f"w{x}" for x in rng.integers(0, 10_000, 100)]
        else:
            words = texts[-1 - int(rng.integers(0, min(k % 12, 4)))].split()
            for at in rng.integers(0, 100, int(rng.integers(1, 4))):
                words[at] = f"v{rng.integers(0, 10_000)}"
        texts.append(" ".join(words))
    return texts


def test_chains_of_edits(spark):
    rows = [(1000 - k, t, k) for k, t in enumerate(chains(240, 5))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, bucket int")).collect()
    check(got, brute([r[:2] for r in rows]))


@pytest.mark.parametrize("linear", [0, 8])
def test_one_bucket_with_many_components(spark, monkeypatch, linear):
    """With every text in the same buckets, pivots, their further rounds and the full rest still find each link."""
    monkeypatch.setattr(near_dedup, "LINEAR", linear)
    signatures = near_dedup._signatures

    def same_bands(ids, texts):
        import pyarrow as pa

        for columns in signatures(ids, texts):
            some = sum(k is not None for k in columns["words"])
            flat = np.tile(np.arange(near_dedup.BANDS), some)
            columns["bands"] = pa.ListArray.from_arrays(columns["bands"].offsets, pa.array(flat, pa.int64()))
            yield columns

    monkeypatch.setattr(near_dedup, "_signatures", same_bands)
    rows = list(enumerate(chains(48, 9)))
    check(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), brute(rows))


def test_defined_cases(spark):
    long = " ".join(f"x{k}" for k in range(120_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B"), (6, "a b c d e"), (7, "a b c d e f"), (8, "a b c d e"),
        (9, long), (10, long + " y"), (11, "É b c d e"), (12, "é b c d e"),
    ]
    make = lambda r: spark.createDataFrame([(*x, 1, True) for x in r], "doc_id bigint, text string, component int, kept boolean")
    check(near_dedup.near_duplicates(make(rows)).collect(), brute(rows))
    extra = near_dedup.near_duplicates(make([*rows, (4, "A b"), (None, "a b"), (None, None)])).collect()
    assert len(extra) == len(rows) + 3
    assert sorted((r.component_id, r.kept) for r in extra if r.doc_id == 4) == [(4, True)] * 2
    assert all(r.component_id is None and r.kept for r in extra if r.doc_id is None)
    assert near_dedup.near_duplicates(make(rows[:3])).count() == 3
    assert near_dedup.near_duplicates(make(rows).limit(0)).count() == 0
    kept = near_dedup.one_of_each(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 11, 12] and kept.columns[-1] == "kept"


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
