"""Ids of words on every letter, and the memory of batches of tiny pieces."""

import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caregap.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_letter_before_a_mark(spark):
    """Each code point that is a letter, before a comma, a full stop and both, equals the library."""
    words = packing.WordIds(PATH)
    letters = [chr(c) for c in range(0x20, 0x110000) if unicodedata.category(chr(c)).startswith("L")]
    assert len(letters) > 100_000
    texts = [f"{x}{mark}" for x in letters for mark in (",", ".")]
    wanted = [e.ids for e in words.library.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, ids in zip(texts, wanted, strict=True) if np.frombuffer(words.ids(t), "<u4").tolist() != ids]
    assert wrong == []


@pytest.mark.parametrize("text", ["İ.", "क़.", "KİTAP, İstanbul. İ", "aक़, b", "ŉ. ǰ, ΐ.", "ﬁ. ﬀ,", "é, é. é", "İ..", "Ⅷ. ª, º."])
def test_letters_that_become_a_letter_and_a_mark(spark, text):
    words = packing.WordIds(PATH)
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


def test_batches_are_bounded_by_pieces(spark, monkeypatch):
    """Half a million empty texts are many batches, each of a bounded number of pieces, and lose no token."""
    taken = spark.range(500_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("length"))
    packed = packing.pack(packing.materialize(taken)).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    batch = F.expr("(sequence_id DIV 2) >> 24")
    sizes = packed.groupBy(batch.alias("batch")).agg(F.sum("n").alias("n"), F.max("n").alias("widest")).collect()
    assert sum(r.n for r in sizes) == 500_000 and len(sizes) == -(-500_000 // packing.BATCH_PIECES)
    assert max(r.n for r in sizes) < 1.1 * packing.BATCH_PIECES
    assert max(r.widest for r in sizes) <= packing.WINDOW
