"""The pipeline against a brute-force version of its stages, each on the rows its predecessor kept."""

import corpus_pipeline
from caregap.llm import language_id, near_dedup
from caregap.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_text_operators import brute_contamination, check_packing, rows_of

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out()))
    first = {}
    for r in docs.collect():
        language, score = model.predict((r.text or "").encode())
        if language != "und" and score >= model.reject_below:
            first[r.doc_id] = r.text
    assert len(first) >= 0.99 * docs.filter("text IS NOT NULL").count()
    second = {i: t for i, (t, _, _) in brute_lines(list(first.items())).items()}
    near = brute_near(list(second.items()), corpus_pipeline.NEAR_PERCENT)
    third = {i: t for i, t in second.items() if near[i][1] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r["doc_id"] for r in brute_contamination(list(third.items()), items, 10) if r["contaminated"]}
    fourth = {i: t for i, t in third.items() if i not in bad}
    assert len(fourth) < len(third) < len(second)

    kept = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (first, second, third, fourth), strict=False):
        kept = stage(spark, kept, SF)
        assert tuple(kept.columns) == DOCUMENT_COLUMNS
        got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
        assert {i: t for i, (t, _) in got.items()} == want, name
        assert all(n == len(t) for t, n in got.values())
    check_packing(rows_of(corpus_pipeline.run(spark, SF)), fourth)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, and no rows at all pass through every stage."""
    rows = [(1, None, None, None, None), (None, "the x", "en", "s", 5), (2, "", "en", "s", 0), (3, "the of and\n\nthe of", "en", "s", 3),
            (3, "the of and\n\nthe of", "en", "s", 3), (4, "der die und das ist", "de", "s", 3)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()


def test_representatives_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in near_dedup.one_of_each(docs).collect()}
    assert kept == {r.component_id for r in near_dedup.near_duplicates(docs).collect()}
