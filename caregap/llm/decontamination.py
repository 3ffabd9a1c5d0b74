"""Benchmark decontamination: broadcast n-grams of the test items, scanned over token windows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import SLICE_BYTES, bounded_batches, texts_only
from caregap.session import materialize

N_GRAM = 10
# Benchmark text broadcast at once; a larger benchmark is scanned in several passes.
BROADCAST_BYTES = 64 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Words: ASCII letters and digits, lower-cased, and everything beyond ASCII. All other bytes are gaps.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SPAN = "struct<item_id:bigint,first_word:int,end_word:int,first_byte:int,end_byte:int>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


@dataclass
class NGrams:
    """Windows of the items of one slice of the benchmark, by length (``n``, or a short item's own)."""

    vocabulary: dict[bytes, int]
    windows: dict[int, dict[bytes, list[int]]]  # length -> word numbers as bytes -> items
    hashes: dict[int, np.ndarray]  # length -> sorted window hashes

    @classmethod
    def of(cls, items: list[tuple[int, bytes | None]], n: int) -> NGrams:
        vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64)
            size = min(n, len(numbers))
            for k in range(len(numbers) - size + 1 if size else 0):
                windows[size][numbers[k : k + size].tobytes()].add(item)
        hashes = {
            size: np.unique(_rolling(np.frombuffer(b"".join(found), np.int64), np.arange(len(found)) * size, size))
            for size, found in windows.items()
        }
        return cls(vocabulary, {s: {w: sorted(i) for w, i in found.items()} for s, found in windows.items()}, hashes)

    def find(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, end word) of every occurrence, adjoining ones of an item joined."""
        known = np.concatenate(([0], np.cumsum(numbers != 0)))
        runs: dict[int, list[list[int]]] = defaultdict(list)
        for size, hashes in self.hashes.items():
            if len(numbers) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            h = _rolling(numbers, starts, size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for start in starts[hashes[at] == h].tolist():
                # The words themselves decide, not the hash.
                for item in self.windows[size].get(numbers[start : start + size].tobytes(), ()):
                    runs[item].append([start, start + size])
        found = []
        for item, spans in runs.items():
            spans.sort()
            joined = [spans[0]]
            for start, end in spans[1:]:
                if start <= joined[-1][1]:
                    joined[-1][1] = max(end, joined[-1][1])
                else:
                    joined.append([start, end])
            found += [(item, start, end) for start, end in joined]
        return sorted(found)


def _rolling(numbers: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    values = numbers.astype(np.uint64)
    for k in range(size):
        h = (h + values[starts + k]) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N_GRAM,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words and the hit spans of every document.

    A window is ``n`` consecutive words of an item; an item with fewer words is
    one window, one without words is none. Words are lower-cased (A-Z) runs of
    ASCII letters, digits and characters beyond ASCII.

    The benchmark's size is summed first. Up to ``broadcast_bytes`` of text it
    goes to the workers whole, as a hash set with the windows behind it; above,
    it is cut by item into slices of that size and the documents, stored between
    passes, are scanned once per slice, with the same result.

    Spans are ``item_id, first_word, end_word, first_byte, end_byte`` (ends
    exclusive), one for each item and unbroken stretch.
    """
    rows = texts_only(docs, id_col, text_col)
    bounded_batches(docs.sparkSession)
    slices = _slices(benchmark, n, broadcast_bytes)
    for k, grams in enumerate(slices):
        last = k == len(slices) - 1
        rows = rows.mapInArrow(
            _scanner(grams, not last),
            f"doc_id bigint, {'' if last else 'text string, '}n_words bigint, spans array<{_SPAN}>",
        )
        if not last:
            rows = materialize(rows)
    return rows


def _slices(benchmark: DataFrame, n: int, broadcast_bytes: int) -> list:
    """Broadcast n-grams of the whole benchmark, or of several slices of it where it is larger than ``broadcast_bytes``."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // broadcast_bytes))
    slices = []
    for k in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        held = [(r.item_id, (r.text or "").encode()) for r in part.collect()]  # about broadcast_bytes of text
        slices.append(spark.sparkContext.broadcast(NGrams.of(held, n)))
    return slices


def _scanner(grams, keep_text: bool):
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), *((c, pa.int32()) for c in ("first_word", "end_word", "first_byte", "end_byte"))])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: NGrams = grams.value
        for batch in batches:
            step = max(1, min(batch.num_rows, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                before = part.column("spans").to_pylist() if "spans" in part.schema.names else repeat(None, len(texts))
                n_words, spans = [], []
                for text, old in zip(texts, before, strict=False):
                    plain = (text or b"").translate(_WORDS)
                    words = plain.split()
                    numbers = np.fromiter(map(own.vocabulary.get, words, repeat(0)), np.int64, len(words))
                    found = own.find(numbers) if len(words) else []
                    if found:
                        at = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
                        found = [
                            {"item_id": i, "first_word": a, "end_word": b, "first_byte": at[a][0], "end_byte": at[b - 1][1]}
                            for i, a, b in found
                        ]
                    n_words.append(len(words))
                    spans.append((old or []) + found)
                columns = [part.column("doc_id")] + ([part.column("text")] if keep_text else [])
                names = ["doc_id"] + (["text"] if keep_text else []) + ["n_words", "spans"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(spans, kind)], names=names)

    return run


def report(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit (words in any span), n_items, items_sha256, contaminated."""
    item_ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"].cast("string"))))
    hit_words = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["first_word"], s["end_word"] - 1)))
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size(hit_words).cast("bigint").alias("n_hit"),
        F.size(item_ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(item_ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, **names: str) -> DataFrame:
    """Contamination report of all documents.

    Defined cases: null and empty texts have no words and are clean; null and
    repeated ids keep their rows; null or wordless items match nothing; equal
    windows of several items count for each; an empty benchmark leaves all clean;
    other columns are not read.
    """
    return report(hits(docs, benchmark, n, **names))


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The documents (text and any other columns) without any hit, judged row by row in place."""

    def only_clean(grams):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: NGrams = grams.value
            for batch in batches:
                texts = batch.column("text")
                clean = []
                for k in range(batch.num_rows):
                    words = words_of((texts[k].as_py() or "").encode())
                    numbers = np.fromiter(map(own.vocabulary.get, words, repeat(0)), np.int64, len(words))
                    clean.append(not (len(words) and own.find(numbers)))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    bounded_batches(docs.sparkSession)
    for grams in _slices(benchmark, n, broadcast_bytes):
        docs = docs.mapInArrow(only_clean(grams), docs.schema)
    return docs


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM) -> DataFrame:
    """doc_id and the text without its hit stretches (ids must be unique); clean texts are unchanged."""
    found = hits(docs, benchmark, n).filter(F.size("spans") > 0).select("doc_id", "spans")
    joined = docs.select("doc_id", "text").join(found, "doc_id", "left")
    return joined.select("doc_id", F.udf(_cut, "string", useArrow=True)("text", "spans").alias("text"))


def _cut(text, spans):
    if not spans:
        return text
    data, out, end = text.encode(), [], 0
    for a, b in sorted((s["first_byte"], s["end_byte"]) for s in spans):
        out.append(data[end : max(a, end)])
        end = max(end, b)
    return b"".join([*out, data[end:]]).decode("utf-8", "replace")
