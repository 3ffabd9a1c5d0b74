"""Collocations of two to five words per language, by best-first branch and bound.

A phrase is cut into a first part with count l and a rest with count r; with a
occurrences among n words it scores 1000 a n / (l r), at its worst cut. As a <= r and a
phrase is no more frequent than its first word, nothing that starts with a word of
count f scores above 1000 n / f, and likewise for its last word. So phrases grow from
rare words first: a round counts what starts or ends with a word of the frontier,
longer phrases only where each known pair inside is frequent. A language is settled
once its last place scores above the bound of all words outside the frontier, which
leaves out no tie. Else its last score so far tells how frequent a word may be that
can still matter, and the next round takes exactly these; a language with too few
phrases goes on with twice the words.

Words and pairs reach the tasks as bit filters of a fixed size. A wrong hit counts a
phrase too many, which an exact join drops; nothing is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregap.llm.common import SLICE_BYTES, map_texts
from caregap.session import materialize

TOP = 2000
MIN_COUNT = 100
MAX_WORDS = 5
# Share of the frequent words of a language, rarest first, that a round starts from; the last is all.
FRONTIER = (0.5, 1.0)
# Bits of a filter: 4 MB on the driver and in every task.
FILTER_BITS = 1 << 25
_COUNTS = "lang string, phrase string, n bigint"
_PHRASE = ["lang", "phrase"]
_STEP = 31
# A-Z become lower case, tabs blanks, and every mark that ends a piece a comma.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"," * 9)


def collocations(
    docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Phrases stand ``min_count`` times or more and lie in no longer phrase of as many
    occurrences. Order is by score and a descending, then by the phrase's bytes.

    Defined cases: a null text is empty; a null language is ``und``, the same as that
    word; rows with equal texts count each; a language without a phrase gives no row,
    so an empty table gives none; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    every = materialize(_counted(texts, _words))
    totals = materialize(every.groupBy("lang").agg(F.sum("n").cast("bigint").alias("total"), F.max("n").alias("most")))
    words = materialize(every.filter(F.col("n") >= min_count))
    known = _bit_filter(words)
    limits = _first_limits(words, totals, FRONTIER[0])
    done = []
    for share in (*FRONTIER[1:], 1.0, 1.0):
        if limits.isEmpty():
            break
        front = materialize(words.join(limits.select("lang", "limit"), "lang").filter("n <= limit").drop("limit"))
        phrases = _frontier_phrases(texts.join(limits, "lang", "left_semi"), words, known, front, min_count, max_words)
        found = materialize(_ranked(_scored(phrases, front, limits, min_count), top))
        last = found.filter(F.col("rank") == top).select("lang", F.col("score").alias("last"))
        bound = F.expr("1000 * total DIV (limit + 1)")
        state = materialize(limits.join(last, "lang", "left").withColumn("open", (F.col("limit") < F.col("most")) & F.coalesce(F.col("last") <= bound, F.lit(True))))
        done.append(found.join(state.filter(~F.col("open")), "lang", "left_semi"))
        left = state.filter("open").select("lang", "last")
        # No word of more occurrences than 1000 n / (score of the last place) can begin or end a phrase that counts.
        reach = F.when(F.col("last").isNull(), F.col("limit")).otherwise(F.least(F.expr("1000 * total DIV last"), F.col("most")))
        limits = materialize(_first_limits(words.join(left, "lang", "left_semi"), totals, share).join(left, "lang").withColumn("limit", reach).drop("last"))
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    if not done:
        return _ranked(_scored(words, words, limits, min_count), top).select(*columns)
    return reduce(DataFrame.unionByName, done).select(*columns)


def _first_limits(words: DataFrame, totals: DataFrame, share: float) -> DataFrame:
    """(lang, limit, total, most): the count up to which the rarest words of a language are in the frontier."""
    limits = words.groupBy("lang").agg(F.percentile_approx("n", share).alias("limit")).join(totals, "lang")
    return materialize(limits.withColumn("limit", F.when(F.lit(share) < 1, F.col("limit")).otherwise(F.col("most"))))


# --- counting in the tasks ------------------------------------------------------------


def _counted(texts: DataFrame, count, *shared) -> DataFrame:
    """Sums of what ``count`` finds in the texts of one language of a slice; ``shared`` are broadcast filters."""

    def work(langs: pa.Array, texts: list[bytes | None]) -> Iterator[dict]:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(langs.to_pylist(), texts, strict=True):
            if text:
                by_lang.setdefault(lang, []).append(text.translate(_FOLD))
        for lang, own in by_lang.items():
            for part in _parts(own):
                marked = part.replace(b",", b" , ").strip(b" ").decode()
                coded = pc.ascii_split_whitespace(pa.array([marked])).values.dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                for phrases, counts in count(lang.encode(), ids, coded.dictionary, *(s.value for s in shared)):
                    yield {"lang": pa.repeat(lang, len(phrases)), "phrase": phrases, "n": counts}

    return map_texts(texts, work, _COUNTS, keys=("lang",)).groupBy(*_PHRASE).agg(F.sum("n").cast("bigint").alias("n"))


def _parts(texts: list[bytes]) -> Iterator[bytes]:
    """The texts of a slice in one, and a very long text in parts that end where a piece ends."""
    joined = b",".join(texts)
    at = 0
    while at < len(joined):
        end = joined.rfind(b",", at, at + 2 * SLICE_BYTES) + 1 if len(joined) - at > 2 * SLICE_BYTES else len(joined)
        if end <= at:
            end = joined.find(b",", at) + 1 or len(joined)
        yield joined[at:end]
        at = end


def _words(lang: bytes, ids: np.ndarray, kinds: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    counts = np.bincount(ids, minlength=len(kinds))
    real = np.flatnonzero(_hashes(lang, kinds) >= 0)
    yield kinds.take(pa.array(real)), counts[real]


def _pairs(lang: bytes, ids: np.ndarray, kinds: pa.Array, known, front) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Pairs of frequent words, one of them at least in the frontier."""
    hashes = _hashes(lang, kinds)
    frequent, begins = (_hits(f, hashes) for f in (known, front))
    a, b = ids[:-1], ids[1:]
    at = np.flatnonzero(frequent[a] & frequent[b] & (begins[a] | begins[b]))
    _, first, counts = np.unique(a[at] * len(kinds) + b[at], return_index=True, return_counts=True)
    yield _phrases(ids, kinds, at[first], 2), counts


def _longer(max_words: int):
    def count(lang: bytes, ids: np.ndarray, kinds: pa.Array, known, front, pairs) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases of three words or more that start or end in the frontier, grown word by word from their first pair."""
        hashes = _hashes(lang, kinds)
        frequent, begins = (_hits(f, hashes) for f in (known, front))
        a, b = ids[:-1], ids[1:]
        fits = frequent[a] & frequent[b]
        at = np.flatnonzero(fits & (begins[a] | begins[b]))
        fits[at] = _hits(pairs, hashes[a[at]] * _STEP + hashes[b[at]])
        grown = np.flatnonzero(fits)
        name = a[grown] * len(kinds) + b[grown]
        for size in range(3, max_words + 1):
            more = np.flatnonzero(grown + size - 1 < len(ids))
            more = more[fits[grown[more] + size - 2]]
            _, name = np.unique(name[more], return_inverse=True)
            grown = grown[more]
            name = name * len(kinds) + ids[grown + size - 1]
            wanted = np.flatnonzero(begins[ids[grown]] | begins[ids[grown + size - 1]])
            _, first, counts = np.unique(name[wanted], return_index=True, return_counts=True)
            yield _phrases(ids, kinds, grown[wanted[first]], size), counts

    return count


def _phrases(ids: np.ndarray, kinds: pa.Array, at: np.ndarray, size: int) -> pa.Array:
    return pc.binary_join_element_wise(*[kinds.take(pa.array(ids[at + i])) for i in range(size)], " ")


def _hashes(lang: bytes, kinds: pa.Array) -> np.ndarray:
    """A number per word; the mark between pieces has none of a word, as it is in no filter."""
    seed = zlib.crc32(lang + b"\0")
    return np.array([-1 if k == b"," else zlib.crc32(k, seed) for k in kinds.cast(pa.binary()).to_pylist()], dtype=np.int64)


def _hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the phrases behind the hashes may be in a filter."""
    place = hashes % (64 * len(bits))
    return (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool) & (hashes >= 0)


def _bit_filter(phrases: DataFrame):
    """Broadcast bits of all (lang, phrase) rows: at most FILTER_BITS / 64 numbers come to the driver, whatever the table holds."""
    word = lambda w: F.crc32(F.concat(F.col("lang"), F.lit("\0"), w).cast("binary"))
    hashed = F.aggregate(F.split("phrase", " "), F.lit(0).cast("bigint"), lambda h, w: h * _STEP + word(w))
    rows = (
        phrases.select(F.pmod(hashed, F.lit(FILTER_BITS)).alias("place"))
        .groupBy(F.expr("place DIV 64").alias("slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bits)


# --- scores -----------------------------------------------------------------------------


def _frontier_phrases(
    texts: DataFrame, words: DataFrame, known, front: DataFrame, min_count: int, max_words: int
) -> DataFrame:
    """(lang, phrase, n) of the frequent words and of all frequent phrases that start or end in the frontier."""
    begins = _bit_filter(front)
    pairs = materialize(_counted(texts, _pairs, known, begins).filter(F.col("n") >= min_count))
    parts = [words, pairs]
    if max_words > 2:
        longer = _counted(texts, _longer(max_words), known, begins, _bit_filter(pairs))
        parts.append(longer.filter(F.col("n") >= min_count))
    return materialize(reduce(DataFrame.unionByName, parts))


def _scored(phrases: DataFrame, front: DataFrame, limits: DataFrame, min_count: int) -> DataFrame:
    """Phrases with both ends in the frontier and in no longer phrase of their count, with their worst cut."""
    split = phrases.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))
    ends = front.select("lang", F.col("phrase").alias("end"))
    inside = split.filter("size > 1 AND n >= " + str(int(min_count)))
    for at in (F.element_at("words", 1), F.element_at("words", -1)):
        inside = inside.withColumn("end", at).join(ends, ["lang", "end"], "left_semi")

    def part(first: Column | int, length: Column) -> Column:
        return F.array_join(F.slice("words", first, length), " ")

    shorter = split.filter("size > 2").select(
        "lang", "n", F.explode(F.array(part(1, F.col("size") - 1), part(2, F.col("size") - 1))).alias("phrase")
    )
    held = shorter.groupBy(*_PHRASE).agg(F.max("n").alias("longer"))
    alone = inside.join(held, _PHRASE, "left").filter("longer IS NULL OR longer < n")
    cuts = alone.select("lang", "phrase", "words", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    counts = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    cuts = cuts.join(limits.select("lang", F.col("total").alias("n")), "lang")
    # 4, 15 and 15 digits make 36, so no product is cut.
    score = F.expr("CAST(1000 AS DECIMAL(4)) * CAST(a AS DECIMAL(15)) * CAST(n AS DECIMAL(15)) DIV (CAST(l AS DECIMAL(15)) * CAST(r AS DECIMAL(15)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "n", "worst.l", "worst.r", "worst.score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))
