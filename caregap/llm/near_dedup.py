"""Near duplicates: MinHash bands, checked signatures, full sets, and connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts, texts_only
from caregap.llm.components import connected_components
from caregap.session import materialize

SHINGLE = 5
# Links: 100 * intersection >= percent * union; this is the limit of op4, callers may pass another.
PERCENT = 85
ROWS = 5
HASHES = 128
# The members of buckets that stay mixed get longer signatures.
FINE_HASHES = 1024
# Largest chance that the bands miss a pair at the limit, and how far below its mean a signature may fall.
_MISS = 1e-6
_DEVIATIONS = 5.5


@dataclass(frozen=True)
class Limits:
    """What follows from the percentage at which two documents are linked."""

    percent: int
    bands: int
    # Equal bits of two one-bit signatures below which a pair at the limit would be more than five and a half deviations off.
    least_equal_bits: int
    least_equal_fine_bits: int

    @classmethod
    def of(cls, percent: int) -> Limits:
        if not 0 < percent < 100:
            raise ValueError(f"percent must lie between 0 and 100: {percent}")
        same = (1 + percent / 100) / 2  # chance that a pair at the limit has an equal bit

        def least(n: int) -> int:
            return math.floor(n * same - _DEVIATIONS * math.sqrt(n * same * (1 - same)))

        bands = math.ceil(math.log(_MISS) / math.log1p(-((percent / 100) ** ROWS)))
        return cls(percent, bands, least(HASHES), least(FINE_HASHES))


_OP4 = Limits.of(PERCENT)
BANDS = _OP4.bands
_FINE = [f"fine{k}" for k in range(FINE_HASHES // 64)]
# Pivot rounds go on while the pairs left to compare exceed this multiple of the bucket members.
LINEAR = 8
_BLOCK = 1 << 16
_CACHE_BYTES = 32 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SIGNATURE = "doc_id bigint, n_shingles bigint, words binary, bands array<bigint>, bits0 bigint, bits1 bigint"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or b"").lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Distinct word shingles as sorted 64-bit hashes; a shorter text is one shingle, none without words.

    Two of a pair's shingles share a hash with a chance of about n * n / 2**65.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out + hashes[k : n - size + 1 + k]) * _FACTOR
        out ^= out >> np.uint64(32)
    return np.unique(out)


@cache
def _universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of ``n`` universal hashes."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(sets: list[np.ndarray], n: int = HASHES, seed: int = 20_241) -> np.ndarray:
    """Smallest value of each of ``n`` universal hashes over each non-empty set: len(sets) x n."""
    factors, shifts = _universal(n, seed)
    out = np.full((len(sets), len(factors)), np.iinfo(np.uint32).max, np.uint32)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= _BLOCK):
            total += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        for low in range(0, len(flat), _BLOCK):  # more than one turn only for a single large set
            part = flat[low : low + _BLOCK]
            at = starts if last - first > 1 else np.zeros(1, np.int64)
            for j in range(len(factors)):
                found = np.minimum.reduceat((part * factors[j] + shifts[j]) >> np.uint64(32), at)
                out[first:last, j] = np.minimum(out[first:last, j], found.astype(np.uint32))
        first = last
    return out


def _signatures(ids: pa.Array, texts: list[bytes | None], n_bands: int = BANDS):
    sets: list[np.ndarray] = []
    keys: list[bytes | None] = []
    for text in texts:
        words = words_of(text)
        sets.append(shingle_set(words))
        keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
    some = [k for k, s in enumerate(sets) if len(s)]
    low = minima([sets[k] for k in some], max(HASHES, n_bands * ROWS))
    bands = np.zeros((len(some), n_bands), np.uint64)
    for r in range(ROWS):
        bands = (bands + low[:, r : n_bands * ROWS : ROWS]) * _FACTOR
        bands ^= bands >> np.uint64(29)
    bands = (bands + np.arange(n_bands, dtype=np.uint64)) * _FACTOR
    bits = _one_bit(low[:, :HASHES])
    ends = np.zeros(len(sets), np.int64)
    ends[some] = n_bands
    all_bits = np.zeros((len(sets), 2), np.int64)
    all_bits[some] = bits
    yield {
        "doc_id": ids,
        "n_shingles": [len(s) for s in sets],
        "words": keys,
        "bands": pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(ends))), pa.int32()), pa.array(bands.view(np.int64).ravel())
        ),
        "bits0": pa.array(all_bits[:, 0]),
        "bits1": pa.array(all_bits[:, 1]),
    }


def _one_bit(low: np.ndarray) -> np.ndarray:
    """Lowest bit of every minimum, 64 to a number."""
    return np.packbits((low & 1).astype(np.uint8), axis=1).view(np.int64)


def _fine_signatures(ids: pa.Array, texts: list[bytes | None]):
    bits = _one_bit(minima([shingle_set(words_of(t)) for t in texts], FINE_HASHES, 20_242))
    yield {"doc_id": ids, **{c: pa.array(np.ascontiguousarray(bits[:, k])) for k, c in enumerate(_FINE)}}


class _Sets(dict):
    """Shingle sets of recently seen texts, at most ``_CACHE_BYTES``; texts meet again in the pairs of a group."""

    held = 0

    def __missing__(self, text: bytes) -> np.ndarray:
        found = shingle_set(words_of(text))
        size = len(text) + found.nbytes
        if self.held + size > _CACHE_BYTES:
            self.clear()
            self.held = 0
        if size <= _CACHE_BYTES:
            self[text] = found
            self.held += size
        return found


def _verifier(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep the pairs whose full shingle sets are similar enough."""
        sets = _Sets()
        for batch in batches:
            left = batch.column("text_a").cast(pa.binary())
            right = batch.column("text_b").cast(pa.binary())
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                one, other = sets[left[k].as_py()], sets[right[k].as_py()]
                both = np.concatenate((one, other))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"]
            )

    return verify


def _equal_bits(x: str, y: str, columns: list[str]):
    return 64 * len(columns) - sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in columns)


def _near(x: str, y: str, limits: Limits):
    """Pairs that the sizes and the signatures leave open (``x`` and ``y`` are column prefixes)."""
    nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * limits.percent) & (
        _equal_bits(x, y, ["bits0", "bits1"]) >= limits.least_equal_bits
    )


class _Linker:
    """Links between class representatives, found bucket by bucket without listing all pairs of a bucket."""

    def __init__(self, docs: DataFrame, classes: DataFrame, limits: Limits):
        self.docs, self.classes, self.limits = docs, classes, limits
        members = classes.select("rep", "n_shingles", "bits0", "bits1", F.explode("bands").alias("bucket"))
        shared = (
            members.groupBy("bucket")
            .agg(F.min("rep").alias("low"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("size"))
            .filter("low < top")
            .select("bucket", "size")
        )
        held = materialize(members.join(shared, "bucket"))
        # The text that most others were made from meets the most of them: it is the best pivot of its buckets.
        company = held.groupBy("rep").agg(F.sum("size").alias("company"))
        self.members = materialize(held.drop("size").join(company, "rep"))
        self.texts = materialize(docs.join(company.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those whose whole texts confirm the link."""
        texts = self.texts
        with_b = pairs.distinct().join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(self.limits.percent), "a bigint, b bigint"))

    def pivots(self, candidates: DataFrame) -> DataFrame:
        """For each bucket the candidate with the most company, the smallest of equal ones."""
        best = F.max(F.struct("company", (-F.col("rep")).alias("minus")))
        return candidates.groupBy("bucket").agg(best.alias("best")).select("bucket", (-F.col("best.minus")).alias("pivot"))

    def to_pivots(self, members: DataFrame, pivots: DataFrame) -> DataFrame:
        """Open pairs of each member with the pivot of its bucket: one row per membership at most."""
        heads = self.classes.select(F.col("rep").alias("pivot"), "n_shingles", "bits0", "bits1")
        return (
            members.drop("pivot").join(pivots, "bucket").filter("pivot <> rep").alias("m")
            .join(heads.alias("p"), "pivot").filter(_near("m", "p", self.limits))
            .select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        )

    def mixed(self, links: DataFrame, first: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components: label, the pivot and its label (home), bucket size."""
        labels = connected_components(links)
        marked = self.members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "label", F.coalesce("component", "rep")
        ).drop("component")
        several = (
            marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
            .filter("lo < hi AND size > 2").select("bucket", "size")
        )
        homes = first.join(marked.select("bucket", F.col("rep").alias("pivot"), F.col("label").alias("home")), ["bucket", "pivot"])
        return materialize(marked.join(several.join(homes, "bucket"), "bucket"))

    def links(self) -> DataFrame:
        """All confirmed links that decide the components.

        Every member is compared with the pivot of its bucket. A bucket whose members
        are then in one component is done. In the others, the members outside the
        pivot's component (strays) must still be compared with all members of other
        components. While that is much more than linear and pivots help, a round with
        another pivot among the strays comes first, which is linear. Then the rest is
        compared in full; sizes and signatures are looked at inside the join, so only
        open pairs come out of it, each in one bucket only.
        """
        first = materialize(self.pivots(self.members))
        links = self.confirmed(self.to_pivots(self.members, first))
        before = None
        while True:
            mixed = self.mixed(links, first)
            strays = mixed.filter("label <> home")
            work = strays.agg(F.sum("size")).first()[0]
            if not work:
                return links
            if work <= LINEAR * mixed.count() or (before and work > before / 2):
                break
            before = work
            links = links.unionByName(self.confirmed(self.to_pivots(mixed, self.pivots(strays))))
        texts = self.texts.join(mixed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        fine = map_texts(texts, _fine_signatures, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _FINE))
        fine = materialize(fine.withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"]).join(self.classes.select("rep", "bands"), "rep"))
        strays = strays.join(fine, "rep")
        mixed = mixed.join(fine, "rep")
        x, y = strays.alias("x"), mixed.alias("y")
        # A pair of strays would meet twice, and a pair with the pivot was compared before.
        rest = x.join(
            y,
            (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.pivot") != F.col("y.rep"))
            & ((F.col("y.label") == F.col("y.home")) | (F.col("x.rep") < F.col("y.rep"))) & _near("x", "y", self.limits)
            & (_equal_bits("x", "y", _FINE) >= self.limits.least_equal_fine_bits)
            & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")),
        ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        return links.unionByName(self.confirmed(rest))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Component of near-duplicate texts for every document.

    Words are lower-cased (A-Z) and split at ASCII white space; a document's set
    holds its distinct five-word shingles, or its whole word sequence if shorter.
    Two documents are linked when 100 times the common shingles are at least
    ``percent`` times all shingles of both.

    Documents with the same word sequence form a class first; only the smallest id
    of a class is hashed into bands of ``ROWS`` minima, as many as ``Limits`` derives
    from ``percent`` (24 at 85, 35 at 80): they miss a pair at the limit with a
    chance of 1e-6, closer pairs with less. Candidates go through sizes and one-bit
    signatures (128 bits, in mixed buckets also 1024), which lose a pair at the limit
    with a chance below 1e-6; then whole texts confirm them.

    Defined cases: null texts and texts without words are linked with nothing; a
    row with a null id is linked with nothing, its component is null and it is
    kept; rows that share an id get equal ``kept``; an empty table gives no rows;
    other columns are not read.

    Returns doc_id, n_shingles, component_id, kept.
    """
    limits = Limits.of(percent)
    texts = texts_only(docs, id_col, text_col)
    work = _signatures if limits.bands == BANDS else partial(_signatures, n_bands=limits.bands)
    rows = materialize(map_texts(texts, work, _SIGNATURE))
    linked = rows.filter("doc_id IS NOT NULL AND words IS NOT NULL")
    classes = materialize(
        linked.groupBy("words").agg(
            F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "bits0", "bits1"))
        )
    )
    components = connected_components(_Linker(texts, classes, limits).links())
    home = (
        classes.select("words", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("words", F.coalesce("component", "rep").alias("component"))
    )
    placed = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("words")).alias("words"))
    return placed.join(home, "words", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which one stays for each component, all columns kept."""
    gone = near_duplicates(docs, percent=percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
