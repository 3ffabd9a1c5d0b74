"""Bytes that belong to a long string standing at two places of the corpus, by prefix-free parsing.

A window of 8 bytes is a trigger of a start if its hash is the smallest of the next
``window`` windows. Starts with one trigger form a phrase; a start and the trigger it
sees depend on the next ``length`` bytes alone, so equal strings see their trigger at
the same distance and phrases cut alike wherever they stand. A dictionary entry is a
phrase with the bytes that complete its last string. What all strings of a phrase
share (its core, the bytes from the trigger on) is the order's first key, the whole
entry its second:

- a core that stands once has no repeated string,
- an entry that stands twice repeats with all its strings,
- one entry of every other kind is cut into phrases of fewer starts and ranked again.

So large groups of copies cost one entry, and only entries at the edge of a repeat
come down to single strings. Ranks are equality classes: removal asks which suffixes
agree on ``length`` bytes, never which comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts
from caregap.session import materialize

LENGTH = 200
# Starts per phrase when an entry is cut again; 1 leaves single strings.
CUTS = (16, 1)
_GRAM = 8
# Rows of a frequent core meet its totals in this many groups.
_SALTS = 8
_KEY = ("doc_id", "version")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
# ``place`` is start << 16 | lead << 8 | starts: first start of the phrase, its distance to the trigger, number of starts.
_PIECES = "doc_id bigint, version bigint, place bigint, core bigint, e1 bigint, e2 bigint"
KEPT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _window(length: int) -> int:
    """Starts that see one trigger at most: a power of two, about two thirds of the strings and less than 256."""
    if not 24 <= length <= 380:
        raise ValueError("strings of 24 to 380 bytes can be compared")
    return 1 << (length * 2 // 3).bit_length() - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, version and text; ``version`` tells texts under one id apart, rows alike in both have the same spans."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _beside(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Each keyed document with the list of its places."""
    lists = lists.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), how)
    return joined.drop("_id", "_version")


def _place(start, lead, starts):
    return start << 16 | lead << 8 | starts


def _names(cores: list[bytes], entries: list[bytes]) -> dict[str, np.ndarray]:
    """64 bits for what strings share, which only prunes, and 128 bits for a whole entry, which decides."""
    core = np.array([xxhash.xxh3_64_intdigest(c) for c in cores], dtype=np.uint64).view(np.int64)
    entry = np.frombuffer(b"".join(blake2b(e, digest_size=16).digest() for e in entries), dtype="<i8")
    return {"core": core, "e1": entry[::2], "e2": entry[1::2]}


def phrases(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, version, place, core, entry) of the phrases of all texts."""
    window = _window(length)
    core = length - window + 1

    def work(ids: pa.Array, versions: pa.Array, texts: list[bytes | None]) -> Iterator[dict]:
        ids, versions = ids.to_pylist(), versions.to_pylist()
        sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
        data = b"".join(t or b"" for t in texts)
        owner, start, stop, trigger = _cut(data, sizes, length, window)
        begin = np.cumsum(sizes) - sizes
        yield {
            "doc_id": pa.array(ids, pa.int64()).take(pa.array(owner)),
            "version": pa.array(versions, pa.int64()).take(pa.array(owner)),
            "place": _place(start - begin[owner], trigger - start, stop - start),
            **_names(
                [data[t : t + core] for t in trigger.tolist()],
                [data[a : b + length - 1] for a, b in zip(start.tolist(), stop.tolist(), strict=True)],
            ),
        }

    return map_texts(docs, work, _PIECES, keys=_KEY)


def _cut(data: bytes, sizes: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """(text number, first start, end of starts, trigger) of the phrases of joined texts."""
    ends = np.cumsum(sizes)
    holds = np.flatnonzero(sizes >= length)
    if not len(holds):
        return (np.empty(0, dtype=np.int64),) * 4
    grams = np.ndarray((len(data),), dtype="<u8", buffer=data + bytes(_GRAM), strides=(1,))
    hashed = (grams ^ (grams >> np.uint64(32))) * _MIX[0]
    hashed = (hashed ^ (hashed >> np.uint64(29))) * _MIX[1]
    # The place in the low bits makes the smallest hash one place, the first of equal ones.
    low = np.uint64((1 << 31) - 1)
    best = (hashed & ~low) | np.arange(len(data), dtype=np.uint64)
    step = 1
    while step < window:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    trigger = (best & low).astype(np.int64)
    first, end = ends[holds] - sizes[holds], ends[holds] - length + 1
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[1 : len(trigger)] = trigger[1:] != trigger[:-1]
    opens[first] = opens[end] = True
    start = np.flatnonzero(opens)
    stop = np.append(start[1:], len(data))
    owner = np.searchsorted(first, start, side="right") - 1
    inside = (owner >= 0) & (start < end[owner])
    start, stop, owner = start[inside], stop[inside], owner[inside]
    return holds[owner], start, stop, trigger[start]


def cut_again(docs: DataFrame, entries: DataFrame, starts: int, length: int = LENGTH) -> DataFrame:
    """Phrases of at most ``starts`` starts from the given entries (doc_id, version, place).

    Cuts lie at fixed distances from the trigger, so equal strings stay in equal cuts.
    """
    lists = entries.groupBy(*_KEY).agg(F.sort_array(F.collect_set("place")).alias("places"))
    listed = _beside(docs, lists, "inner")

    def work(ids: pa.Array, versions: pa.Array, places: pa.Array, texts: list[bytes | None]) -> Iterator[dict]:
        rows: dict[str, list] = {c: [] for c in ("doc_id", "version", "place")}
        cores, whole = [], []
        for doc_id, version, own, text in zip(ids.to_pylist(), versions.to_pylist(), places.to_pylist(), texts, strict=True):
            for place in own:
                start, lead, n = place >> 16, place >> 8 & 255, place & 255
                trigger, nearest = start + lead, lead - n + 1
                for cell in range(nearest // starts * starts, lead + 1, starts):
                    far, near = min(lead, cell + starts - 1), max(nearest, cell)
                    rows["doc_id"].append(doc_id)
                    rows["version"].append(version)
                    rows["place"].append(_place(trigger - far, far, far - near + 1))
                    cores.append(text[trigger - cell : trigger + length - cell - starts + 1])
                    whole.append(text[trigger - far : trigger + length - near])
        yield rows | _names(cores, whole)

    return map_texts(listed, work, _PIECES, keys=(*_KEY, "places"))


def ranked(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated places, open entries) of phrases; ``pieces`` is computed twice.

    Rows meet per core and per entry as counts only, folded before the shuffle. One
    place stands for an open entry, also where the entry stands more than once: the
    strings of other entries may be its strings.
    """
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))).alias("salt")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "version", "place"), F.lit(_SALTS)))
    cores = (
        pieces.groupBy("core")
        .agg(F.count("*").alias("n"), F.min("e1").alias("low"), F.max("e1").alias("high"))
        .filter("n > 1")
        .select("core", (F.col("low") == F.col("high")).alias("alike"), salts)
    )
    found = materialize(pieces.join(cores, ["core", "salt"]))
    mixed = found.filter(~F.col("alike"))
    one = F.min(F.struct(*_KEY, "place")).alias("one")
    entries = materialize(mixed.groupBy("core", "e1", "e2").agg(F.count("*").alias("n"), one))
    twice = entries.filter("n > 1").select("core", "e1", "e2", salts)
    repeated = found.filter("alike").select(*_KEY, "place").unionByName(
        mixed.join(twice, ["core", "e1", "e2", "salt"], "left_semi").select(*_KEY, "place")
    )
    return repeated, entries.select("one.*")


def repeated_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, version, place) of all starts of strings that stand elsewhere, too; ``docs`` is keyed."""
    found, left = ranked(phrases(docs, length))
    parts = [found]
    for starts in CUTS:
        found, left = ranked(materialize(cut_again(docs, left, starts, length)))
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per document: its UTF-8 bytes without the repeated ones.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else as
    well, in this or another document. ``kept`` is binary, as a span may end inside a
    character; ``n_spans`` counts the stretches that went.

    Defined cases: a null text is empty; texts shorter than ``length`` stay; rows alike
    in id and text are two documents, so both go if long enough; a null id stays null;
    other columns are not read; an empty table gives no rows. Places of one document
    are gathered in one row, nothing else is.
    """
    keyed = _keyed(docs)
    spans = (
        repeated_places(keyed, length)
        .groupBy(*_KEY)
        .agg(F.sort_array(F.collect_set(_first_and_count(F.col("place")))).alias("spans"))
    )
    joined = _beside(keyed, spans, "left")

    def work(ids: pa.Array, spans: pa.Array, texts: list[bytes | None]) -> Iterator[dict]:
        rows: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
        for own, text in zip(spans.to_pylist(), texts, strict=True):
            kept, gone, at = [], 0, 0
            for place in own or ():
                start, stop = place >> 8, (place >> 8) + (place & 255) + length - 1
                if start > at or not gone:
                    kept.append(text[at:start])
                    gone += 1
                at = max(at, stop)
            rest = b"".join([*kept, (text or b"")[at:]])
            rows["n_bytes"].append(len(text or b""))
            rows["n_removed"].append(len(text or b"") - len(rest))
            rows["n_spans"].append(gone)
            rows["kept"].append(rest)
        yield {"doc_id": ids, **rows}

    return map_texts(joined, work, KEPT_SCHEMA, keys=("doc_id", "spans"))


def _first_and_count(place: Column) -> Column:
    """Start and number of starts in one number that sorts by start."""
    return F.shiftleft(F.shiftright(place, 16), 8).bitwiseOR(place.bitwiseAND(F.lit(255)))
