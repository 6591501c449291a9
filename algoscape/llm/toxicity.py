"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (words of digits, letters and code points over 127, lower-cased A-Z): each distinct word, word stem
(its first bytes, ``STEMS`` lengths, for inflected words), pair of neighbours and pair with one word between, hashed to
``DIMENSIONS`` buckets, value 1. Per-coordinate learning rates follow each feature's own gradients, and L1 keeps most
weights at exactly zero, so the model that is broadcast is a short list of (bucket, weight): at most
16 * DIMENSIONS bytes.

The model is fitted on at most ``TRAINING_ROWS`` labelled rows, chosen by a hash of id and text, in one task that a lost
executor only repeats. Scoring is one narrow scan over all documents; only the text enters a score.

Defined cases: null and empty texts score the bias alone; very long texts are read whole; without labelled rows every text
scores about 0; repeated rows are scored one by one and train once, rows of one id with different texts train each;
several labels of one id count as their maximum; null labels and ids are left out of training; a score equal to the
threshold is toxic; an empty table gives an empty result; only the named columns are read, others are passed on.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from . import kernel as K
from .sampling import bounded_hashes
from .scratch import bounded_batches

DIMENSIONS = 1 << 20
STEMS = (4, 5, 6)
#: Bound of labelled rows that the model is fitted on.
TRAINING_ROWS = 12_000
EPOCHS = 3
#: Documents with this score or more count as toxic.
THRESHOLD = 0.3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature occurrence and its document, for a string array."""
    w = K.words(column, K.ALNUM, fold=True)
    n, doc, end = len(w.hash), w.doc_of(), w.doc_end()
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    found, docs = [w.hash], [doc]
    for size in STEMS:
        i = np.flatnonzero(w.end - w.start >= size)
        found.append(K.span_hashes(w.buf, w.start[i], w.start[i] + size, fold=True, family=1))
        docs.append(doc[i])
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            i = np.flatnonzero(np.arange(n) + gap < end)
            found.append(K.mix64(w.hash[i] * np.uint64(salt) + w.hash[i + gap]))
            docs.append(doc[i])
    return (np.concatenate(found) >> shift).astype(np.int64), np.concatenate(docs)


@dataclass
class Ftrl:
    """FTRL-proximal state: z sums gradients less the proximal shifts, n sums squared gradients."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z = np.zeros(DIMENSIONS)
        self.n = np.zeros(DIMENSIONS)
        self.bias = 0.0
        self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + self.bias, -30, 30))) - label
        before = self.n[at]
        after = before + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[at] = after
        self.bias_n += g * g
        self.bias -= self.alpha * g / (self.beta + np.sqrt(self.bias_n))


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Score 0 to 1 of each text of a string array."""
        if not hasattr(self, "dense"):
            self.dense = np.zeros(DIMENSIONS)
            self.dense[self.buckets] = self.weights
            self.any = self.dense != 0
        at, doc = features(column)
        used = self.any[at]
        key = np.unique(doc[used] * DIMENSIONS + at[used])
        total = np.bincount(key // DIMENSIONS, weights=self.dense[key % DIMENSIONS], minlength=len(column)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _train(text: str, label: str):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one growing block, which goes back to the system at once: the worker lives on and reads other stages' rows
        held, bounds, labels = array("i"), [0], array("i")
        for s in K.slices(batches, text):
            at, doc = features(s.column(0))
            key = np.unique(doc * DIMENSIONS + at)
            bounds += (len(held) + np.searchsorted(key, np.arange(1, s.num_rows + 1) * DIMENSIONS)).tolist()
            held.frombytes((key % DIMENSIONS).astype(np.int32).tobytes())
            labels.extend(s.column(1).to_pylist())
        buckets = np.frombuffer(held, dtype=np.int32)
        model = Ftrl()
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(labels)):
                model.learn(buckets[bounds[i] : bounds[i + 1]], labels[i])
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(w[used], model.bias))], names=["bucket", "weight"])

    return one


def fit(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` of the labelled documents."""
    ship_package(documents.sparkSession)
    bounded_batches(documents.sparkSession)
    named = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(toxic).cast("int").alias("__y"))
    given = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.lit(3), doc_id, text).alias("h"))
    # rows are chosen by id and hash alone; of the texts only the chosen ones move
    hashes = given.select("id", "h").join(named.withColumnRenamed(doc_id, "id"), "id").groupBy("h").agg(F.max("__y").alias("__y"))
    chosen = given.join(F.broadcast(bounded_hashes(hashes, rows)), "h").dropDuplicates(["h"])
    one = chosen.repartition(1).sortWithinPartitions("h")
    got = one.select("text", "__y").mapInArrow(_train("text", "__y"), "bucket long, weight double").toPandas()
    last = got.bucket == -1
    bias = float(got.weight[last].sum())
    if last.all() and bias == 0.0:  # no labelled row: nothing is called toxic
        bias = -30.0
    return Model(got.bucket[~last].to_numpy(), got.weight[~last].to_numpy(), bias)


def score(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(sent.value.score(s.column(1)))], names=[doc_id, "score"])

    kind = documents.select(doc_id).schema[0].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(one, f"`{doc_id}` {kind}, score double")


def remove_toxic(documents: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, all columns unchanged."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            yield s.filter(pa.array(sent.value.score(s.column(s.schema.get_field_index(text))) < threshold))

    return documents.mapInArrow(one, documents.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_tables(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the queries: labels of held-out rows are never read."""
    return fit(documents, labels.where(~held_out()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, held_out, score, predicted."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = score(documents, fit_tables(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
