"""Packing token pieces into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts, texts_only
from caregap.session import materialize

WINDOW = 2048
# A document's rest behind its full windows is cut into near-equal pieces of at most this length.
PIECE = 512
# Windows that one differencing run fills; runs are independent of each other.
BATCH_WINDOWS = 256
# Pieces that one run takes at most: each starts with two rows of numbers, one per window.
BATCH_PIECES = 1 << 14
# The memo holds at most two halves of so many words.
MEMO_WORDS = 500_000
MEMO_CHARS = 64
_LATIN_END = 0x250
# Letters, single digits and runs of other marks: the pre-tokens of an ASCII word without apostrophes.
_ASCII_PARTS = re.compile("[A-Za-z]+|[0-9]|[^A-Za-z0-9]+").findall


class WordIds(dict):
    """Memo from a word (no white space) to its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its words in order. Further splits are exact for its
    pre-tokenizer: a comma or full stop behind letters is a pre-token of its own
    (some letters become a letter and a mark, so the normalised word is asked),
    letters, digits and marks of an ASCII word are pre-tokens of their own unless it
    holds an apostrophe or an added token, and letters are lower-cased. A word of
    Latin letters is one pre-token, so the library's merge model takes it directly,
    without normaliser and pre-tokenizer; ``__init__`` compares both ways on samples.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        sample = "Ab, cd.\n<|endoftext|> E\t's"
        whole = self.library.encode(sample, add_special_tokens=False).ids
        parts = [i for w in sample.split() for i in self.library.encode(w, add_special_tokens=False).ids]
        if whole != parts:
            raise ValueError("this tokenizer does not treat white space as a border")
        self.merge = self.library.model.tokenize
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # An id as bytes: a lookup is cheaper than an array of a few numbers per word.
        self.codes = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab().values()) + 1)]
        # The byte-level alphabet: visible Latin-1 characters stand for their byte, the others for 256, 257, ...
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        samples = [f"{x}{y}{x}thed" for x in map(chr, range(97, _LATIN_END)) for y in "eé" if (x * 2).isalpha() and x == x.lower()]
        for word in samples:
            if self._letters(word) != self._library(word):
                raise ValueError(f"the merge model alone does not give the ids of {word!r}")
        for word in ("a1b22c", "Ab#1", "x@y.z", "(a)--b", "1.2,3", "a\rb", "\x0b#a", "a<|endoftext|>b", "it's#"):
            if self[word] != self._library(word):
                raise ValueError(f"letters, digits and marks of {word!r} are not pre-tokens of their own")

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self._new(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                # Frequent words come back from the older half; only the others are forgotten.
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        if word.isalpha():
            lower = word.lower()
            # ASCII letters are in normal form already.
            if word.isascii():
                ids = self._letters(word) if lower == word else self[lower]
            elif ord(max(word)) < _LATIN_END and is_normalized("NFC", word):
                ids = self._letters(word) if lower == word else self[lower] if lower.isalpha() else self._library(word)
            else:
                ids = self._library(word)
        else:
            stem = word[:-1]
            if word[-1:] in (",", ".") and stem.isalpha() and (stem.isascii() or self._normal(stem).isalpha()):
                ids = self[stem] + self[word[-1]]
            elif word.isascii() and "'" not in word and len(parts := _ASCII_PARTS(word)) > 1 and not any(t in word for t in self.added):
                ids = b"".join(map(self.__getitem__, parts))
            else:
                ids = self._library(word)
        return ids

    def _normal(self, word: str) -> str:
        return self.library.normalizer.normalize_str(word) if self.library.normalizer else word

    def _library(self, word: str) -> bytes:
        return np.asarray(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        plain = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        code = self.codes
        return b"".join([code[t.id] for t in self.merge(plain)])

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def cut_points(n: int, window: int, piece: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens, and ``n``: full windows first, then near-equal pieces."""
    full = n // window * window
    rest = n - full
    parts = -(-rest // piece)
    return [*range(0, full, window), *(full + rest * k // parts for k in range(parts)), n]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = WINDOW,
    piece: int = PIECE,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenize every text, append ``end_id`` and cut into pieces.

    Returns doc_id, start, length, ids_crc32, doc_tokens, and ids (binary,
    unsigned 32-bit little-endian) if asked for.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    end = np.asarray([end_id], "<u4").tobytes()

    def work(ids: pa.Array, texts: list[bytes | None]):
        words = _words(tokenizer)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
            tokens = words.ids((text or b"").decode("utf-8", "replace")) + end
            n = len(tokens) // 4
            cuts = cut_points(n, window, piece)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = tokens[4 * a : 4 * b]
                out["doc_id"].append(doc_id)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(n)
                out["ids"].append(part)
        yield out

    return map_texts(texts_only(docs, id_col, text_col), work, schema + (", ids binary" if with_ids else ""))


def differencing(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and the window sums, by multiway differencing.

    Every entry of the heap is a partial partition: ``windows`` sums in ascending
    order. The two with the widest spread are merged, the largest sums of one
    with the smallest of the other.
    """
    n = len(lengths)
    left, right = [-1] * n, [-1] * n  # a node joins the items of two nodes
    heap = []
    for item in range(n):
        sums = np.zeros(windows, np.int64)
        nodes = np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = lengths[item], item
        heap.append((-int(lengths[item]), item, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other_sums, other_nodes = heapq.heappop(heap)
        other_nodes = other_nodes[::-1]
        merged = sums + other_sums[::-1]
        joined = np.maximum(nodes, other_nodes)
        both = np.flatnonzero((nodes >= 0) & (other_nodes >= 0))
        if len(both):
            joined[both] = np.arange(len(left), len(left) + len(both))
            left += nodes[both].tolist()
            right += other_nodes[both].tolist()
        order = np.argsort(merged, kind="stable")
        merged, joined = merged[order], joined[order]
        heapq.heappush(heap, (int(merged[0] - merged[-1]), serial, merged, joined))
        serial += 1
    _, _, sums, nodes = heap[0]
    window_of = np.empty(n, np.int64)
    for window, node in enumerate(nodes):
        todo = [int(node)] if node >= 0 else []
        while todo:
            k = todo.pop()
            if k < n:
                window_of[k] = window
            else:
                todo += (left[k], right[k])
    return window_of, sums


def fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item with no window above ``capacity``; the number of windows rises until all fit."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window_of, sums = differencing(lengths, windows)
        if sums.max() <= capacity:
            return window_of
        windows += max(1, windows // 100)


def pack(pieces: DataFrame, window: int = WINDOW, batch_windows: int = BATCH_WINDOWS) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, start, length, ...).

    Full windows are sequences of their own. All other pieces are dealt by a hash
    of their place in the stored table into batches of about ``batch_windows``
    windows and ``BATCH_PIECES`` pieces at most, so no document, source or copied text can fill a batch, and each
    batch is packed on its own.
    """
    placed = pieces.withColumn("place", F.monotonically_increasing_id())
    rest = placed.filter(F.col("length") < window)
    tokens, count = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    batches = max(1, round(tokens / window / batch_windows), -(-count // BATCH_PIECES))
    schema = rest.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint")).drop("batch").schema

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").drop(columns="batch").reset_index(drop=True)
        rows["sequence_id"] = fit(rows["length"].to_numpy(), window) + (key[0] << 24)
        rows["sequence_id"] = rows["sequence_id"] * 2 + 1
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows

    mixed = (
        rest.withColumn("batch", F.pmod(F.xxhash64("place"), F.lit(batches)))
        .groupBy("batch")
        .applyInPandas(work, schema)
    )
    full = (
        placed.filter(F.col("length") == window)
        .withColumn("sequence_id", F.col("place") * 2)
        .withColumn("offset", F.lit(0).cast("bigint"))
    )
    return mixed.unionByName(full).drop("place")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens; one row per piece.

    The pieces (no ids, about 40 bytes each) are stored once; packing moves only
    them. Defined cases: null and empty texts hold the end id alone; null and
    repeated ids are packed like others; an empty table gives no rows; other
    columns are not read.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    return pack(materialize(token_pieces(docs, tokenizer, end_id, id_col=id_col, text_col=text_col)))


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence in order, from pieces packed with their ids: sequence_id, length, ids (binary).

    A group holds at most one window of tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids")
    )
