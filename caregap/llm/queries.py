"""Named queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregap.llm import (
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    periodic_runs,
    phrase_dedup,
    phrase_mining,
    sharding,
    token_counts,
)
from caregap.llm.common import table
from caregap.session import apply_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(apply_defaults(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


@query("op1_sharding")
def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


@query(
    "op6_exact_dedup",
    """
    WITH norm AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM norm WINDOW w AS (PARTITION BY t)
    """,
)
def _exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"), keep="max")


@query("op2_html_extraction")
def _html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op3_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_near_dedup")
def _near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_token_counts")
def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_line_dedup", line_dedup.ORACLE)
def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_license_scans")
def _license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def _language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def _plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the periodic stretch that the query's contract puts into every tenth document."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


@query("op11_periodic_runs")
def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), rewrite=_plant_period)
    return periodic_runs.run_digest(found)


@query("op12_suffix_dedup")
def _suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Python's list indices do not reach here: words are cut by DuckDB's 1-based lists, counts multiply as HUGEINT.
_COLLOCATIONS = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece
    FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
phrases AS (
    SELECT lang, m, phrase, count(*) AS n FROM (
        SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, range(1, 6) t(m)))
    GROUP BY ALL),
totals AS (SELECT lang, sum(n)::HUGEINT AS n FROM phrases WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE n >= 100),
cuts AS (
    SELECT c.lang, c.phrase, c.m, c.n AS a, k, l.n AS l, r.n AS r, t.n AS n,
           (1000::HUGEINT * c.n * t.n) // (l.n::HUGEINT * r.n) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1) c
    JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
    JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')
    JOIN totals t ON t.lang = c.lang),
worst AS (SELECT lang, phrase, a, n, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM cuts GROUP BY ALL),
alone AS (
    SELECT * FROM worst p WHERE NOT EXISTS (
        SELECT 1 FROM often o WHERE o.lang = p.lang AND 100 * o.n >= 100 * p.a AND o.phrase <> p.phrase
          AND contains(' ' || o.phrase || ' ', ' ' || p.phrase || ' '))),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM placed WHERE rank <= 2000
"""


@query("op13_phrase_mining", _COLLOCATIONS)
def _phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))
