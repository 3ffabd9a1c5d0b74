"""Near duplicates at other limits than that of op4, against all pairs."""

from itertools import combinations

import pytest

import corpus_pipeline
from caregap.llm import near_dedup
from tests.llm.test_near_dedup import chains


def brute(rows, percent):
    """doc_id -> component from all pairs."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def pairs(n):
    """Two texts each of 100 words, two words apart: their shingle sets are alike to 86 / 106."""
    rows = []
    for k in range(n):
        words = [f"w{k}x{j}" for j in range(100)]
        other = list(words)
        other[30] = other[70] = f"v{k}"
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(other), "en", "s", 1)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_limit_is_a_parameter(spark, percent):
    rows = list(enumerate(chains(240, 11)))
    want = brute(rows, percent)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert want != brute(rows, near_dedup.PERCENT)


def test_stage_drops_copies_between_the_limits(spark):
    docs = spark.createDataFrame(pairs(40), SCHEMA)
    kept = corpus_pipeline.remove_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))
    assert near_dedup.one_of_each(docs).count() == 80


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = brute(rows, corpus_pipeline.NEAR_PERCENT)
    kept = {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, c in want.items() if i == c}
    assert kept < {i for i, c in brute(rows, near_dedup.PERCENT).items() if i == c}


def test_limits_follow_from_the_percentage():
    for percent in (70, 80, 85, 90):
        limits = near_dedup.Limits.of(percent)
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** limits.bands <= 1e-6
    assert near_dedup.Limits.of(80) == near_dedup.Limits(80, 35, 96, 868)
    with pytest.raises(ValueError):
        near_dedup.Limits.of(0)
