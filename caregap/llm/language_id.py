"""Language identification: averaged hashed subword embeddings with a linear softmax, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caregap.llm.common import bounded_batches, map_texts, texts_only

# Bound of the training sample, in all and per language; the driver holds its n-gram counts.
SAMPLE_ROWS = 4000
SAMPLE_PER_LANGUAGE = 1000
BUCKETS = 1 << 14
DIMENSIONS = 16
SIZES = (1, 2, 3)
UNKNOWN = "und"
# Share of the rightly labelled calibration texts that may be rejected.
REJECT_SHARE = 0.001
# Other ASCII than letters is a gap; A-Z is lower-cased, UTF-8 bytes beyond ASCII stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def subwords(text: bytes) -> np.ndarray:
    """Buckets of all byte n-grams of the whole text, gaps included as word borders."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out)


@dataclass
class LanguageModel:
    """Weights per bucket and language (embedding times output layer), temperature and rejection level."""

    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: bytes) -> np.ndarray:
        counts = np.bincount(subwords(text), minlength=BUCKETS)
        return _softmax((counts @ self.weights / counts.sum() + self.bias) / self.temperature)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """Language and its probability; ``und`` with 0 for null and for texts without a letter."""
        if not self.languages or not text or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Features = tuple[np.ndarray, np.ndarray]


def fit(languages: list[str], rows: list[Features], labels: np.ndarray, epochs: int = 12, rate: float = 2.0) -> LanguageModel:
    """Train by stochastic gradient descent on rows of (buckets, share of each in the text's n-grams).

    A tenth of the rows is left out for calibration: the temperature minimises its
    log loss, and the rejection level is the score below which ``REJECT_SHARE`` of
    its right answers lie (at most one half).
    """
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 10], order[len(rows) // 10 :]
    c = len(languages)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = rng.normal(0, 0.1, (DIMENSIONS, c)).astype(np.float32)
    bias = np.zeros(c, np.float32)
    target = np.eye(c, dtype=np.float32)[labels]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 16)):
            mean = np.stack([rows[k][1] @ embedding[rows[k][0]] for k in part])
            error = (_softmax(mean @ output + bias) - target[part]) / len(part)
            back = error @ output.T
            output -= step * (mean.T @ error)
            bias -= step * error.sum(axis=0)
            for k, own in zip(part, back, strict=True):
                embedding[rows[k][0]] -= step * 20 * np.outer(rows[k][1], own)
    weights = embedding @ output
    temperature, level = 1.0, 0.0
    if len(held):
        z = np.stack([rows[k][1] @ weights[rows[k][0]] for k in held]) + bias

        def loss(t: float) -> float:
            return float(-np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), labels[held]], 1e-12)).mean())

        temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        p = _softmax(z / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == labels[held]]
        level = min(0.5, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return LanguageModel(languages, weights, bias, temperature, level)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of labelled rows: at most ``SAMPLE_PER_LANGUAGE`` for a language and ``SAMPLE_ROWS`` in all.

    The rows with the smallest hash of id and text are taken, so the choice does
    not depend on partitions. Workers turn the whole texts into n-gram counts;
    the driver gets at most ``BUCKETS`` counts a row.
    """
    rows = labelled.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(label_col).cast("string").alias("label"),
    ).filter("label IS NOT NULL AND text RLIKE '\\\\p{L}'")
    lot = F.xxhash64("doc_id", "text")
    # The key of a row is its hash, so only keys are ranked; texts are fetched for the chosen rows alone.
    keys = rows.select("label", lot.alias("lot"))
    # Hashes are uniform: twice the wanted share of a label holds its smallest ones, so a frequent label
    # sends about that many keys to its ranking, however many tasks read it. At most SAMPLE_ROWS labels count.
    sizes = {r.label: r["count"] for r in keys.groupBy("label").count().orderBy(F.desc("count"), "label").limit(SAMPLE_ROWS).collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * SAMPLE_PER_LANGUAGE / n))])
    if sizes:
        keys = keys.filter(F.col("lot").cast("double") / 2.0**64 + 0.5 <= share[F.col("label")])
    ranked = keys.withColumn("no", F.row_number().over(Window.partitionBy("label").orderBy("lot")))
    chosen = ranked.filter(F.col("no") <= SAMPLE_PER_LANGUAGE).orderBy("no", "lot").limit(SAMPLE_ROWS).select("lot", "label")
    wanted = {(r.lot, r.label) for r in chosen.collect()}  # at most SAMPLE_ROWS pairs
    languages = sorted({label for _, label in wanted})
    bounded_batches(labelled.sparkSession)
    shared = labelled.sparkSession.sparkContext.broadcast({x for x, _ in wanted})
    picked = rows.select("text", "label", lot.alias("lot"))
    schema = "lot bigint, label string, buckets binary, shares binary"

    def featurize(batches):
        for batch in batches:
            out = {k: [] for k in ("lot", "label", "buckets", "shares")}
            lots = batch.column("lot").to_pylist()
            for k in [k for k, x in enumerate(lots) if x in shared.value]:
                counts = np.bincount(subwords(batch.column("text")[k].as_py().encode()), minlength=BUCKETS)
                used = np.flatnonzero(counts)
                out["lot"].append(lots[k])
                out["label"].append(batch.column("label")[k].as_py())
                out["buckets"].append(used.astype("<u2").tobytes())
                out["shares"].append((counts[used] / counts.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict(
                out, pa.schema([("lot", pa.int64()), ("label", pa.string()), ("buckets", pa.binary()), ("shares", pa.binary())])
            )

    found = {(r.lot, r.label): r for r in picked.mapInArrow(featurize, schema).dropDuplicates(["lot", "label"]).collect()}
    found = [found[k] for k in sorted(found) if k in wanted]
    x = [(np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.shares, "<f4")) for r in found]
    labels = np.array([languages.index(r.label) for r in found], np.int64)
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), 1.0, 0.0)
    return fit(languages, x, labels)


def held_out(id_col: str = "doc_id"):
    """The fifth of the documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score, accepted.

    ``accepted`` is false where there is nothing to judge or the score lies below
    the calibrated level. One map over the rows, no shuffle. Defined cases: null
    texts and texts without a letter are ``und`` with score 0; of equally likely
    languages the first in alphabetical order is given; null and repeated ids keep
    their rows; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(ids: pa.Array, texts: list[bytes | None]):
        own = shared.value
        answers = [own.predict(t) for t in texts]
        yield {"doc_id": ids, "lang_pred": [a[0] for a in answers], "score": [a[1] for a in answers]}

    return map_texts(texts_only(docs, id_col, text_col), work, "doc_id bigint, lang_pred string, score double").withColumn(
        "accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.reject_below)
    )


def keep_accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents (doc_id, text and any other columns) whose language is accepted, judged row by row in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column("text")
            accepted = []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                language, score = own.predict(None if text is None else text.encode())
                accepted.append(language != UNKNOWN and score >= own.reject_below)
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
