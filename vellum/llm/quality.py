"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

A word gives two symbols: itself, and its shape (runs of upper case, lower case, digits
and each other sign collapsed to one letter, over the whole word). The features are hashed one- and
two-word grams of both, one gram for a word that follows itself, their counts scaled
to length one, and a bias. Training takes at most SAMPLE labelled documents, those of the
smallest id hashes, so that the sample is the same at every run: their features are made in
parallel, and one task streams them, sorted, through the epochs. Scoring is a sparse dot
product over whole texts, narrow from the scan to the result.

Nulls: a null text is empty, and empty texts score by the bias alone; null labels are left out;
of several labels of one document the least counts, and of several rows of a labelled id the one
of the least text hash teaches. Repeated rows are scored one by one, and equal texts score alike,
so no order decides anything. Very long texts are read whole, a few megabytes of text at a time. With no
labelled rows all scores are 0.5. An empty table gives no rows. Other columns are never
read, whatever their names, and the added column takes a name that none of them has.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import _shared

BITS = 18
SAMPLE = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.1, 0.0
THRESHOLD = 0.3


_AGAIN = np.uint64(xxhash.xxh64_intdigest("a word and the same word", 3))


def shape(word: str) -> str:
    letters = lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"
    out = re.sub(r"[^\W\d_]+", letters, word)
    return re.sub(r"([^Aa])\1+", r"\1", re.sub("[0-9]+", "9", out))


class Featuriser:
    """Hashed grams of texts. Hashes of short words are remembered, up to a bound."""

    def __init__(self, bits: int = BITS, remembered: int = 200_000):
        self.bits, self.mask, self._seen, self._remembered = bits, np.uint64((1 << bits) - 1), {}, remembered

    def _word(self, word: str) -> tuple[int, int]:
        found = self._seen.get(word)
        if found is None:
            found = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(shape(word), 2)
            if len(word) <= 64:
                self._seen[word] = found
        return found

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts: number of the text, bucket, and how often the bucket's grams occur; bucket 0 belongs to the bias."""
        if len(self._seen) > self._remembered:
            self._seen.clear()
        split = [(t or "").split() for t in texts]
        words = list(set().union(*split))
        if not words:
            return (np.empty(0, np.int64),) * 3
        place = dict(zip(words, range(len(words)), strict=True))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        own = np.array(list(map(self._word, words)), dtype=np.uint64)[at]
        text = np.repeat(np.arange(len(split)), sizes)
        pair = np.flatnonzero(text[1:] == text[:-1])
        left, right = own[pair], own[pair + 1]
        twice = pair[left[:, 0] == right[:, 0]]
        grams = np.concatenate([own.ravel(), (left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)).ravel(), np.full(len(twice), _AGAIN)])
        grams ^= grams >> np.uint64(29)
        bucket = np.maximum(grams & self.mask, np.uint64(1)).astype(np.int64)
        owner = np.concatenate([np.repeat(text, 2), np.repeat(text[pair], 2), text[twice]])
        key, n = np.unique((owner << self.bits) | bucket, return_counts=True)
        return key >> self.bits, key & int(self.mask), n


def scaled(text: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
    """The counts of each text scaled to length one."""
    return n / np.maximum(1.0, np.sqrt(np.bincount(text, n.astype(np.float64) ** 2, texts)))[text]


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss (McMahan et al., 2013)."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@lru_cache(maxsize=1)
def _featuriser(bits: int) -> Featuriser:
    return Featuriser(bits)


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """At most ``bound`` labelled documents outside the held-out fold: spread, quality, and their sparse features."""
    own = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_shared.fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("spread", F.xxhash64("doc_id"))
        .orderBy("spread", "doc_id")
        .limit(bound)
    )

    def rows(batches):
        featuriser = _featuriser(bits)
        for part in _shared.slices(batches):
            text, at, n = featuriser(part.column("text").to_pylist())
            cut = np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
            pack = lambda x: pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("spread", "tie", "quality")), pack(at), pack(n)], names=["spread", "tie", "quality", "at", "n"])

    joined = docs.select("doc_id", _shared.whole_text().alias("text")).join(F.broadcast(own), "doc_id")  # `bound` rows of 20 bytes
    labelled = joined.select("spread", F.xxhash64("text").alias("tie"), F.col("quality").cast("int").alias("quality"), "text")
    featured = labelled.mapInArrow(rows, "spread long, tie long, quality int, at binary, n binary")
    return featured.groupBy("spread").agg(F.min_by(F.struct("quality", "at", "n"), "tie").alias("x")).select("spread", "x.*")


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights. One task streams the sample's features, sorted by epoch; only weights that are not zero come to the driver."""

    def learn(batches):
        model = Ftrl(1 << bits)
        for batch in batches:
            for quality, at, n in zip(*(batch.column(c).to_pylist() for c in ("quality", "at", "n")), strict=True):
                at, n = np.frombuffer(at, "<u4"), np.frombuffer(n, "<u4").astype(np.float64)
                x = np.concatenate([[1.0], n / max(1.0, float(np.sqrt((n * n).sum())))])
                model.update(np.concatenate([[0], at.astype(np.int64)]), x, float(quality > 0))
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["at", "w"])

    rounds = sample(docs, labels, bound, bits).select(F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"), "*")
    out = np.zeros(1 << bits)
    for r in rounds.repartition(1).sortWithinPartitions("epoch", "spread").mapInArrow(learn, "at long, w double").collect():
        out[r["at"]] = r["w"]
    return out


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, name: str = "vellum_score") -> DataFrame:
    """docs, columns as they are, and a column of the given name with the score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 4 bytes for each of 2**bits buckets

    def rows(batches):
        w, own = shared.value.astype(np.float64), _featuriser(bits)
        for part in _shared.slices(batches):
            text, at, n = own(part.column("text").to_pylist())
            margin = w[0] + np.bincount(text, w[at] * scaled(text, n, part.num_rows), part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-margin)))], names=[*part.schema.names, f"c{part.num_columns}"])

    return _shared.map_rows(docs, rows, [T.StructField(name, T.DoubleType())])


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, columns as they are, that score threshold or more."""
    name = _shared.free_name(docs, "vellum_score")
    scored = score(docs, fit(docs, labels), name=name)
    return scored.where(F.col(_shared.quoted(name)) >= threshold).select(*_shared.own_columns(docs))


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, _shared.table(spark, sf_dir, "labels"))
    return score(docs, weights, name="score").select(
        "doc_id",
        (_shared.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
