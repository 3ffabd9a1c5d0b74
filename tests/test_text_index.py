"""Index searches equal the scan; only the blocks of the terms are read."""

import random

import pytest

from caregap.operators import review, text_index
from caregap.operators.text_index import TextIndex, grams_of

COLUMNS = ("name", "place")


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(3)
    words = ["anvil", "Anvil", "ΑΣΑ", "straße", "100%", "a_b", "x\\y", "𝒳𝒴𝒵", "an", "", "vil an", None]
    made = [(i % 50, pick.choice(words), pick.choice(words), "clash") for i in range(300)]
    return spark.createDataFrame(made + made[:20], "segment int, name string, place string, gram string").repartition(5)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return TextIndex.build(rows, str(tmp_path_factory.mktemp("index")), COLUMNS)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("term", ["ANVIL", " nvi ", "vil an", "αςα", "ασα", "straß", "100%", "a_b", "𝒳𝒴𝒵", "nowhere", "an", "", "x\\y", "l\x1fa"])
def test_contains_equals_the_scan(rows, index, term):
    assert same(index.contains(term), rows.filter(review.contains_any(term, *COLUMNS)))


@pytest.mark.parametrize("term", ["anv_l", "a%vil", "vil_an", "100", "_", "%", "an%an", "STRA", "nvil%"])
def test_ilike_equals_the_scan(rows, index, term):
    assert same(index.ilike(term), rows.filter(review.ilike_any(term, *COLUMNS)))


def test_only_the_blocks_of_the_terms_are_read(index):
    wanted = index.postings(["anv", "nvi"])
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan and "PushedFilters: [In(gram" in plan
    assert {r.gram for r in wanted.collect()} == {"anv", "nvi"}
    assert all(len(r.offsets) <= 1 << text_index.BLOCK_BITS and r.offsets == sorted(r.offsets) for r in wanted.collect())


def test_an_empty_table(spark, rows, tmp_path):
    empty = TextIndex.build(rows.limit(0), str(tmp_path / "empty"), COLUMNS)
    assert empty.contains("anvil").count() == 0 and empty.contains("an").columns == rows.columns


def test_long_texts_are_linear(spark, tmp_path):
    from pyspark.sql import functions as F

    text = spark.range(1).select(F.repeat(F.lit("abcdefgh "), 100_000).alias("t"))
    assert text.select(F.size(grams_of(F.col("t")))).first()[0] == 9
