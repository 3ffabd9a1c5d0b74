"""Per-text operators against brute force on whole small tables, and their defined cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from caregap.llm import decontamination, exact_dedup, html_text, language_id, license_scan, packing, sharding, token_counts
from caregap.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = P.path("piece_bpe_32k.model")
WORDS = P.path("word_bpe_49k.json")
LONG = "the of and " * 40_000
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a  b \n c\n\n  d "), (6, "É thé, Naïve. İΣΣ. ﬁ ½ ẞ"), (7, LONG),
    (7, LONG), (None, "the x"), (8, "</s> <s> <|endoftext|>x <unk> ▁a"), (9, "\tA\r\nb\x0bc\x85d e　f"),
    (10, "é 日本語テキスト 🙂 it's we'll"), (11, "A\0b"), (12, "x" * 5000), (13, "1234.5,6 %$#@!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like results."""
    rows = [(i, t, "en", 1, 2, "y", True) for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, size int, shard int, h string, kept boolean"
    )


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same(got, want):
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_sharding_is_balanced_and_keeps_copies_together(spark, docs):
    got = rows_of(QUERIES["op1_sharding"](spark, SF))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    sizes, slots, homes = {}, {}, {}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(data, set()).add(r["shard"])
    target = sum(sizes.values()) / 40
    largest = max(r["size"] for r in got)
    assert set(sizes) <= set(range(40))
    assert all(abs(s - target) <= largest for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = [h for t, h in homes.items() if sum((r.text or "").encode() == t for r in docs.collect()) * (len(t) + 16) <= target]
    assert all(len(h) == 1 for h in whole) and len(whole) < len(got)


def test_sharding_splits_hot_groups(spark):
    """A third of all rows are one text: its units spread over the shards, which stay balanced."""
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same text " * 10)).otherwise(F.sha2(F.col("id").cast("string"), 512)).alias("text"),
    )
    sizes = {r["shard"]: r["s"] for r in rows_of(sharding.shard_by_bytes(df, 10).groupBy("shard").agg(F.sum("size").alias("s")))}
    assert len(sizes) == 10 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_sharding_defined_cases(odd):
    got = rows_of(sharding.shard_by_bytes(odd, 3))
    assert len(got) == len(ODD) and sum(r["doc_id"] is None for r in got) == 1
    assert sharding.shard_by_bytes(odd.limit(0), 3).count() == 0


def test_shards_are_written_whole(docs, tmp_path):
    placed = sharding.shard_by_bytes(docs, 4)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def brute_exact(rows, keep):
    classes = {}
    for i, t in rows:
        classes.setdefault((t or "").encode().lower(), []).append(i)
    out = []
    for norm, ids in classes.items():
        known = [i for i in ids if i is not None]
        stays, seen = keep(known) if known else None, False
        for i in ids:
            first = i == stays and not seen
            seen |= first
            out.append(
                {"doc_id": i, "keep_id": stays, "group_size": len(ids), "kept": first, "text_sha256": hashlib.sha256(norm).hexdigest()}
            )
    return out


@pytest.mark.parametrize("rule", ["min", "max"])
def test_exact_dedup(odd, docs, rule):
    keep = {"min": min, "max": max}[rule]
    for df in (odd, docs):
        same(rows_of(exact_dedup.duplicate_classes(df, rule)), brute_exact([(r.doc_id, r.text) for r in df.collect()], keep))
    assert exact_dedup.duplicate_classes(odd.limit(0)).count() == 0
    assert exact_dedup.drop_duplicates(docs, rule).count() == len({(r.text or "").encode().lower() for r in docs.collect()})


def test_token_counts(odd, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (odd, docs):
        want = []
        for r in df.collect():
            n = len(library.encode(r.text or ""))
            want.append({"doc_id": r.doc_id, "n_bytes": len((r.text or "").encode()), "n_tokens": n, "over_limit": n > 4096})
        same(rows_of(token_counts.token_counts(df, PIECES)), want)


def test_every_whole_token_word_is_proven():
    counter = token_counts.PieceCounter(PIECES)
    assert len(counter.proven) > 10_000
    assert all(len(counter.library.encode(w)) == 1 for w in list(counter.proven)[::50])


def test_token_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 10)
    counter = token_counts.PieceCounter(PIECES)
    text = " ".join(f"zq{k}x" for k in range(100))
    assert counter.count(text) == len(counter.library.encode(text)) and len(counter) <= len(counter.proven) + 11


def test_word_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    odd = "Été, ÉTÉ. İx ſs ßẞ ŉa Ǆa ǅa ªº e\u0301t\u00e9 Σς ΑΣ it's IT'S a,b a.. x! 12 1a a1 _ - 'll é' ½".split(" ")
    latin = [chr(a) + chr(b) + "x" for a in range(33, 0x250) for b in (97, 233, 0x301)]
    for w in [*odd, *latin]:
        assert np.frombuffer(words[w], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids, w


def check_packing(rows, texts, exact_ids=True):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    total = sum(r["length"] for r in rows)
    return 1 - total / 2048 / len(by_sequence)


def test_packing(spark, docs, odd):
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packing(rows_of(QUERIES["op3_packing"](spark, SF)), texts) < 0.02
    unique = odd.dropDuplicates(["doc_id"])
    check_packing(rows_of(packing.pack_documents(unique, WORDS)), {r.doc_id: r.text for r in unique.collect()})
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_packed_sequences_round_trip(docs):
    from caregap.session import materialize

    packed = packing.pack(materialize(packing.token_pieces(docs.limit(20), WORDS, with_ids=True)))
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.length <= 4 * 2048


def test_differencing_and_window_count():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 500, 400)
    window_of, sums = packing.differencing(lengths, 50)
    assert np.array_equal(np.bincount(window_of, lengths, 50).astype(int), sums) and sums.max() - sums.min() < 20
    # Three items of 60 do not fit into two windows of 100: the count rises.
    assert sorted(np.bincount(packing.fit(np.array([60, 60, 60]), 100)).tolist()) == [1, 1, 1]


def brute_contamination(texts, items, n):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = []
    for item, text in items:
        w = word.findall(lower(text))
        size = min(n, len(w))
        windows += [(item, tuple(w[k : k + size])) for k in range(len(w) - size + 1)] if size else []
    by_window = {}
    for item, w in windows:
        by_window.setdefault(w, set()).add(item)
    sizes = {len(w) for w in by_window}
    out = []
    for doc_id, text in texts:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if items_here := by_window.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= items_here
        joined = ",".join(sorted(map(str, found)))
        out.append(
            {"doc_id": doc_id, "n_words": len(w), "n_hit": len(hit), "n_items": len(found),
             "items_sha256": hashlib.sha256(joined.encode()).hexdigest(), "contaminated": bool(hit)}
        )
    return out


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], 10)
    assert any(r["contaminated"] for r in want) and not all(r["contaminated"] for r in want)
    same(rows_of(QUERIES["op8_benchmark_decontamination"](spark, SF)), want)
    # A benchmark above the broadcast bound is scanned in slices, with the same result.
    same(rows_of(decontamination.report(decontamination.hits(docs, bench, broadcast_bytes=2000))), want)
    clean = {r["doc_id"] for r in want if not r["contaminated"]}
    assert {r.doc_id for r in decontamination.clean_documents(docs, bench).collect()} == clean
    cut = decontamination.cut_spans(docs, bench)
    assert all(r["n_hit"] == 0 for r in rows_of(decontamination.contamination(cut.filter(F.col("doc_id").isin([*clean])), bench)))
    assert {r.doc_id: r.text for r in cut.collect() if r.doc_id in clean} == {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}


def test_decontamination_defined_cases(spark, odd):
    items = [(1, "THE of, and the"), (2, "the of and the of and the of and the of and"), (3, None), (4, "--"), (5, "x"), (5, "x"), (6, "X!")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    same(rows_of(decontamination.contamination(odd, bench)), brute_contamination(ODD, items, 10))
    same(rows_of(decontamination.contamination(odd, bench.limit(0))), brute_contamination(ODD, [], 10))
    assert decontamination.contamination(odd.limit(0), bench).count() == 0


def test_language_id_on_held_out_documents(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op10_language_id"](spark, SF))}
    truth = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    judged = [r["lang_pred"] == truth[i].lang for i, r in got.items() if r["held_out"] and truth[i].text]
    assert sum(judged) / len(judged) > 0.97


def test_language_id_defined_cases(docs, odd):
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in rows_of(language_id.identify(odd, model))}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 13)] == ["und"] * 5 and got[7]["lang_pred"] == "en"
    assert not got[1]["accepted"] and got[1]["score"] == 0
    assert model.predict("½ ² 12 _ ٣".encode()) == ("und", 0.0) and model.predict("½ x".encode())[0] != "und"
    assert language_id.identify(odd.limit(0), model).count() == 0
    empty = language_id.train(odd.limit(0))
    assert {r["lang_pred"] for r in rows_of(language_id.identify(odd, empty))} == {"und"}
    one = language_id.train(odd)
    assert {r["lang_pred"] for r in rows_of(language_id.identify(odd, one))} == {"und", "en"}


def test_training_does_not_read_held_out_rows(docs):
    """Changing every held-out row leaves the model as it is."""
    kept = docs.filter(~language_id.held_out())
    changed = docs.withColumn("text", F.when(language_id.held_out(), F.lit("zzz")).otherwise(F.col("text")))
    a, b = language_id.train(kept), language_id.train(changed.filter(~language_id.held_out()))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights, atol=1e-5)


PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies and that is all of it
that you have to know about the site.</p></div>%s<div class="sidebar"><p>Other things of the day and more of the same in
the world to see</p></div><section id="comments"><p>I like the article and that it is about the fox in the house of the
dog.</p></section><form><p>The name of the user in the form to be sent is of the essence and all that</p></form>
<footer>&copy; 2020 The Site</footer></body></html>"""
BODY = """<h1>A head</h1><p>The quick brown fox is in the   house of the dog, &amp; it was not happy with that at
all.</p><p>Yes.</p><p>Zyx wvu tsrqp onml kjih gfed cba zyx wvu tsr qpo nml kji hgf edc ba zyx wvu<script>var t="</p>"</script></p>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div role="main">%s</div>'])
def test_main_text_of_an_article(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)).split("\n") == [
        "A head",
        "The quick brown fox is in the house of the dog, & it was not happy with that at all.",
        "Yes.",
        "Zyx wvu tsrqp onml kjih gfed cba zyx wvu tsr qpo nml kji hgf edc ba zyx wvu",
    ]


def test_main_text_without_article_uses_the_block_rules():
    body = BODY.split("<p>Zyx")[0]
    assert html_text.main_text(PAGE % f'<div class="text">{body}</div>').split("\n")[-3:] == [
        "A head", "The quick brown fox is in the house of the dog, & it was not happy with that at all.", "Yes.",
    ]


def test_extraction_of_all_pages(spark):
    """Against the article cut out by markup, on whole pages."""
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows_of(QUERIES["op2_html_extraction"](spark, SF))
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]].url


def test_extraction_defined_cases(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", "<p>", 0), (3, "u", "<div " * 2000, 0), (3, "u", "a < b & c <!-- x", 0),
            (4, "u", "<article>" + "<p>x y z</p>" * 20000, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = rows_of(html_text.extract(pages))
    assert len(got) == len(rows)
    assert {r["text"] for r in got if r["page_id"] in (1, 2, None)} == {""}
    assert max(r["n_chars"] for r in got) == 20000 * 6 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


NOTICE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""


def test_license_rules():
    names = [n for n, _, _ in license_scan.sentences_of(NOTICE)]
    assert names == ["apache-2-ref", "apache-2-comply", "license-copy-at", "asis-unless-required"]
    assert license_scan.licences_of(names) == [("Apache-2.0", 0, 4)]
    assert [x[0] for x in license_scan.licences_of(["mit-ref", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"])] == ["MIT", "BSD-3-Clause"]


def test_license_scan_of_all_documents(spark, docs):
    """Against a plain search for the notices that the documents carry."""
    notices = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
    }
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op9_license_scans"](spark, SF))}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    some = 0
    for r in docs.collect():
        at = sorted((m.start(), v) for k, v in notices.items() for m in re.finditer(re.escape(k), r.text or ""))
        some += bool(at)
        assert got[r.doc_id]["licences"] == ",".join(dict.fromkeys(v for _, v in at))
        assert [(r.text or "").encode()[m["first_byte"] : m["end_byte"]].decode().strip() in notices for m in got[r.doc_id]["matches"]] == [True] * len(at)
    assert some


def test_license_scan_defined_cases(odd):
    got = rows_of(license_scan.scan(odd))
    assert len(got) == len(ODD) and all(r["n_matches"] == 0 and r["licences"] == "" for r in got)
    assert license_scan.scan(odd.limit(0)).count() == 0
