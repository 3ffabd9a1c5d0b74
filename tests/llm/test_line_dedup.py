"""Line chunks against a plain copy of the rule, and the defined cases."""

import hashlib

import duckdb
import pytest

from caregap.llm import line_dedup
from caregap.llm.queries import ORACLE_SQL, QUERIES


def brute(rows):
    """(doc_id, text) with unique ids -> {doc_id: (text, lines, removed)}."""
    seen, cut = set(), {}
    for doc_id, text in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        lines = text.split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        stay, chunk = [], []
        for i, line in enumerate(lines):
            chunk.append(line)
            if i == len(lines) - 1 or (hashes[i] + 31 * (hashes[i - 1] if i else 0)) % line_dedup.MEAN_LINES == 0:
                body = "\n".join(chunk)
                multi = sum(x.strip(" ") != "" for x in chunk) > 1
                if not (multi and body in seen):
                    stay += chunk
                if multi:
                    seen.add(body)
                chunk = []
        cut[doc_id] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return {i: cut.get(i, (t, 0, 0)) for i, t in rows}


def got_of(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_report(df).collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in QUERIES["op7_line_dedup"](spark, sf).collect()} == want
    assert any(r[2] for r in want.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, text, n_lines, n_removed FROM ({ORACLE_SQL['op7_line_dedup']})").fetchall()} == want


PASSAGE = [f"passage line {k}" for k in range(40)]


def test_borders_do_not_shift(spark):
    """A passage behind other lines is found, but for its ends."""
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(k % 7)] + PASSAGE + [f"end {k}"])) for k in range(30)]
    got = got_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == brute(rows)
    assert got[0][2] == 0 and all(got[k][2] >= 25 for k in range(1, 30))


def test_defined_cases(spark):
    long = "\n".join(f"l{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (5, "a\nb\nc"), (6, "a\nb\nc"), (7, long), (8, long), (9, "a"), (10, "a"), (-5, long)]
    make = lambda r: spark.createDataFrame([(*x, 0, "c", [1]) for x in r], "doc_id bigint, text string, no int, digest string, lines array<int>")
    assert got_of(make(rows)) == brute(rows)
    both = line_dedup.line_report(make([*rows, (None, "a\nb\nc"), (None, None), (7, long)])).collect()
    assert len(both) == len(rows) + 3
    assert {r.n_removed for r in both if r.doc_id is None} == {0}
    assert line_dedup.line_report(make(rows).limit(0)).count() == 0
    whole = line_dedup.remove_repeated_lines(make(rows))
    assert whole.columns[:5] == ["doc_id", "text", "no", "digest", "lines"] and whole.count() == len(rows)


def test_long_text_that_keeps_its_lines(spark):
    """32,000 lines of which a few go: the rebuild is linear in the lines."""
    import time

    passage = "\n".join(f"shared {k}" for k in range(40))
    long = "\n".join(f"own {k}" for k in range(16_000))
    rows = [(1, passage), (2, f"{long}\n{passage}\n{long}x"), (3, "\n".join([passage, *(f"z{k}" for k in range(32_000)), passage]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got_of(df)
    start = time.perf_counter()
    got = got_of(df)
    assert time.perf_counter() - start < 10
    assert got == brute(rows)
    assert got[2][2] > 0
