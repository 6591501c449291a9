"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Target text is that of documents labelled good, raw text that of all documents. Both are bags of hashed words and word
pairs (``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z) over ``BUCKETS`` buckets. The log importance weight of a document is the
mean over its n-grams of log target share less log raw share, times ``SHARPNESS`` (the n-grams a text counts as), so
that long texts do not decide by length alone. A fixed Gumbel number from the hash of id and text is added,
and a share of the documents, those with the largest keys, is kept: sampling without replacement in proportion to
the weights.

Counts and weights cover every word of every document. A task counts into one array and forwards it once; the sums are
two arrays of BUCKETS numbers. The k-th largest key is found exactly by counting keys by their leading bits, 16 at a
time, so nothing is sorted or collected; equal keys at the limit are kept together.

Defined cases: null and empty texts weigh 0 and compete by their Gumbel number; without good labels all weights are
0; repeated rows draw the same number and stay or go together; several labels of one id count as their minimum;
a null id has the number of its text; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from . import kernel as K
from .scratch import Scratch, bounded_batches

BUCKETS = 1 << 14
#: N-grams that a text counts as, whatever its length.
SHARPNESS = 100.0
#: The sample keeps the share of good rows among the labelled ones, and this much more.
MARGIN = 0.01


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and document of each word and word pair, and the number of documents."""
    w = K.words(column, K.SPACED, fold=True)
    i = np.flatnonzero(np.arange(len(w.hash)) + 1 < w.doc_end())
    with np.errstate(over="ignore"):
        pair = K.mix64(w.hash[i] * np.uint64(0x9E3779B97F4A7C15) + w.hash[i + 1]) if len(i) else w.hash[:0]
    doc = w.doc_of()
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([w.hash, pair]) >> shift).astype(np.int64), np.concatenate([doc, doc[i]]), len(w.first) - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for s in K.slices(batches, "text"):
        at, doc, _ = ngrams(s.column(0))
        good = s.column(1).to_numpy(zero_copy_only=False).astype(bool)
        total[0] += np.bincount(at, minlength=BUCKETS)
        total[1] += np.bincount(at[good[doc]], minlength=BUCKETS) if len(at) else 0
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "target"])


def log_ratios(documents: DataFrame, good: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(target share / raw share) of each bucket, one added to every count; ``good`` has the ids of target documents."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "ratios")
    ids = scratch.save(good.select(F.col(doc_id).alias("id")).where("id is not null").distinct().withColumn("good", F.lit(True)), "good")
    docs = documents.select(F.col(text).alias("text"), F.col(doc_id).alias("id")).join(F.broadcast(ids) if ids.count() <= 2_000_000 else ids, "id", "left")
    rows = docs.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counts, "bucket long, raw long, target long")
    got = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[got.bucket], target[got.bucket] = raw[got.bucket] + got.raw, target[got.bucket] + got.target
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(documents: DataFrame, ratios: np.ndarray, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, log_weight and key (log weight plus Gumbel number) of every document."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(ratios)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            at, doc, docs = ngrams(s.column(1))
            n = np.bincount(doc, minlength=docs)
            total = np.bincount(doc, weights=sent.value[at], minlength=docs) if len(at) else np.zeros(docs)
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(SHARPNESS * total / np.maximum(n, 1)), s.column(2)], names=["id", "log_weight", "draw"])

    draw = F.xxhash64(doc_id, text, F.lit(11))
    kind = documents.select(doc_id).schema[0].dataType.simpleString()
    out = documents.select(doc_id, text, draw.alias("__draw")).mapInArrow(one, f"id {kind}, log_weight double, draw long")
    # 52 bits of the draw make a uniform number strictly between 0 and 1
    u = (F.shiftrightunsigned("draw", 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return out.select(F.col("id").alias(doc_id), "log_weight", (F.col("log_weight") - F.log(-F.log(u))).alias("key"))


def _ordered(key: Column) -> Column:
    """A key as a whole number of the same order: millionths, shifted to be positive."""
    return F.least(F.greatest(F.round(key * 1e6), F.lit(-(2.0**46))), F.lit(2.0**46)).cast("long") + F.lit(1 << 47)


def kth_largest(rows: DataFrame, value: str, k: int) -> int:
    """The k-th largest of non-negative 48-bit whole numbers, by counts of 16 bits at a time."""
    prefix, left = 0, k
    for shift in (32, 16, 0):
        counts = rows.where(F.shiftright(value, shift + 16) == prefix).groupBy(F.shiftright(value, shift).alias("p")).count()
        for p, n in sorted(counts.collect(), reverse=True):
            if n >= left:
                prefix = p
                break
            left -= n
    return prefix


def good_share(quality: DataFrame) -> float:
    """Share to keep: that of good rows among labelled ones (column q, 1 for good) and MARGIN; all without labels."""
    share = quality.agg(F.avg((F.col("q") == 1).cast("double"))).first()[0]
    return 1.0 if share is None else min(1.0, share + MARGIN)


def resample(documents: DataFrame, good: DataFrame, *, keep: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, log_weight, key and kept of every document."""
    scratch = Scratch(documents.sparkSession, "resample")
    ratios = log_ratios(documents, good, doc_id=doc_id, text=text)
    rows = scratch.save(weigh(documents, ratios, doc_id=doc_id, text=text).withColumn("__order", _ordered(F.col("key"))), "keys")
    n = rows.count()
    k = max(1, int(np.ceil(keep * n)))
    limit = kth_largest(rows, "__order", k) if n else 0
    return rows.select(doc_id, "log_weight", "key", (F.col("__order") >= limit).alias("kept"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, key and kept; the target is the text labelled of good quality."""
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality.where("q = 1"), keep=good_share(quality))
