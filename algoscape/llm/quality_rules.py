"""Quality rules: an isolation forest over rule statistics finds anomalous documents.

Rule statistics of whole texts come from one vectorised scan and are written, some numbers a row; all else reads those.
The forest has ``TREES`` trees of ``DEPTH`` levels. They split at random within the ranges that the statistics have over
all documents that pass the base rule, and the rows of every leaf are counted over all of these documents: nothing is
sampled. (``fit`` can also grow trees on a hashed sample of a given size.) The threshold on the anomaly score is calibrated
on all labelled rows that pass: the score that separates best (true minus false drops), but dropping at most
``MAX_FALSE_DROPS`` of the good ones. Neither gathers rows on the driver: it gets a count a leaf, and sums a range of scores.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: null and empty texts have no words and fail the base rule; very long
texts are read whole; a table without usable labels keeps all that passes the base rule; repeated rows are judged one by
one and count as often as they occur; several labels of one id count as their minimum; documents with equal statistics have equal
scores, and a score equal to the threshold is kept; null ids are scored as others; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from . import kernel as K
from .sampling import bounded_rows
from .scratch import Scratch, bounded_batches

TREES = 100
#: Rows of a tree where ``grow`` is given rows, and levels of a tree that is counted over all rows.
SAMPLE = 256
DEPTH = 8
#: Share of good labelled rows that the threshold may drop.
MAX_FALSE_DROPS = 0.005

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Allowed range of each rule statistic, after widely published heuristics for web text; the forest sees by how
#: much a document is outside, so that all that is within the rules is alike.
ALLOWED = {
    "symbols_per_word": (0.0, 0.1),
    "mean_word": (3.0, 10.0),
    "dup_line_share": (0.0, 0.3),
    "repeat_share": (0.0, 0.3),
    "upper_share": (0.0, 0.3),
    "digit_share": (0.0, 0.2),
    "mark_share": (0.0, 0.1),
    "distinct_words": (0.15, 1.0),
}
STATISTICS = list(ALLOWED)


def _count(buf: np.ndarray, table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return K.span_sum(table[buf], bounds)


def _bytes(members: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=np.int8)
    t[list(members)] = 1
    return t


_SYMBOLS = _bytes(b"#*$%&|<>")
_UPPER = _bytes(bytes(range(65, 91)))
_DIGITS = _bytes(b"0123456789")
_MARKS = _bytes(b"!?;:()[]{}\"/\\+=@_~^")
_LEADS = np.ones(256, dtype=np.int8)
_LEADS[128:192] = 0


def repeated_words(w: K.Words, k: int) -> np.ndarray:
    """Words by document that lie in a k-word window found twice or more in the document."""
    n = len(w.hash)
    if n < k:
        return np.zeros(len(w.first) - 1, dtype=np.int64)
    i = np.flatnonzero(np.arange(n) + k <= w.doc_end())
    doc = w.doc_of()
    with np.errstate(over="ignore"):
        key = K.gram_hashes(w.hash, k)[i] ^ K.mix64(doc[i].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(i) + 1, dtype=bool)
    twice[1:-1] = same
    twice[:-2] |= same
    at = i[order[twice[:-1]]]
    mark = np.zeros(n + 1, dtype=np.int64)
    mark[at] += 1
    np.subtract.at(mark, at + k, 1)
    return w.doc_sum((np.cumsum(mark[:-1]) > 0).astype(np.int64))


def rule_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (documents x 5, integers) and excesses over ALLOWED (documents x STATISTICS) of a string array."""
    w = K.words(column, K.SPACED)
    buf, docs, bounds = w.buf, len(w.first) - 1, w.doc_byte
    n_words = np.diff(w.first)
    lead = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(_LEADS[buf], out=lead[1:])
    chars = w.doc_sum(lead[w.end] - lead[w.start])
    symbols = _count(buf, _SYMBOLS, bounds)

    start, end, first = K.find(buf, bounds, K.LINES)
    held = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    line_doc = np.repeat(np.arange(docs), np.diff(first))
    with_word = held > 0
    key = K.span_hashes(buf, start, end)[with_word] ^ K.mix64(line_doc[with_word].astype(np.uint64) + np.uint64(1))
    n_lines = np.bincount(line_doc[with_word], minlength=docs)
    distinct = np.unique(key, return_index=True)[1]
    dup = n_lines - np.bincount(line_doc[with_word][distinct], minlength=docs)

    repeat = repeated_words(w, 3)
    with np.errstate(over="ignore"):
        own = w.hash ^ K.mix64(w.doc_of().astype(np.uint64) + np.uint64(1))
    distinct_words = np.bincount(w.doc_of()[np.unique(own, return_index=True)[1]], minlength=docs)
    counts = np.stack([n_words, chars, symbols, dup, repeat], axis=1).astype(np.int64)
    per_word, per_char = np.maximum(n_words, 1), np.maximum(chars, 1)
    found = {
        "symbols_per_word": symbols / per_word,
        "mean_word": chars / per_word,
        "dup_line_share": dup / np.maximum(n_lines, 1),
        "repeat_share": repeat / per_word,
        "upper_share": _count(buf, _UPPER, bounds) / per_char,
        "digit_share": _count(buf, _DIGITS, bounds) / per_char,
        "mark_share": _count(buf, _MARKS, bounds) / per_char,
        # long texts use words again: the share of distinct ones is measured against the root of their number
        "distinct_words": np.minimum(distinct_words / np.sqrt(per_word) / 5, 1.0),
    }
    stats = np.stack([np.maximum(found[c] - high, 0) + np.maximum(low - found[c], 0) for c, (low, high) in ALLOWED.items()], axis=1)
    return counts, stats


@dataclass
class Forest:
    """Isolation trees as flat arrays: feature (-1 for a leaf), cut, children; depth holds path lengths of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: list[int]
    norm: float

    @staticmethod
    def _average_path(n: int) -> float:
        """Mean path length of an unsuccessful search in a tree of n rows."""
        if n <= 1:
            return 0.0
        if n == 2:
            return 1.0
        return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    @staticmethod
    def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
        """Random splits of random statistics within low..high, to depth log2(sample); each tree has rows of its own.

        With too few rows for that, trees share rows.
        """
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        limit = int(np.ceil(np.log2(max(size, 2))))
        feature: list[int] = []
        cut: list[float] = []
        left: list[int] = []
        right: list[int] = []
        depth: list[float] = []

        def node(x: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
            k = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, k), (right, k), (depth, level + Forest._average_path(len(x)))):
                a.append(v)
            if level < limit and len(x) > 1:
                free = np.flatnonzero(high > low)
                if len(free):
                    f = int(rng.choice(free))
                    c = float(rng.uniform(low[f], high[f]))
                    feature[k], cut[k] = f, c
                    under, over = high.copy(), low.copy()
                    under[f] = over[f] = c
                    left[k] = node(x[x[:, f] <= c], low, under, level + 1)
                    right[k] = node(x[x[:, f] > c], over, high, level + 1)
            return k

        order = rng.permutation(len(rows))
        own = [order[t * size : (t + 1) * size] if len(rows) >= trees * size else rng.choice(len(rows), size, replace=False) for t in range(trees)] if len(rows) else []
        roots = [node(rows[i], low, high, 0) for i in own]
        return Forest(np.array(feature, dtype=np.int64), np.array(cut), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(depth), roots, max(Forest._average_path(size), 1e-9))

    @staticmethod
    def plan(low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
        """Trees of ``depth`` levels whose rows are not counted yet: random splits of random statistics within low..high."""
        rng = np.random.default_rng(seed)
        feature: list[int] = []
        cut: list[float] = []
        left: list[int] = []
        right: list[int] = []
        levels: list[int] = []

        def node(low: np.ndarray, high: np.ndarray, level: int) -> int:
            k = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, k), (right, k), (levels, level)):
                a.append(v)
            free = np.flatnonzero(high > low)
            if level < depth and len(free):
                f = int(rng.choice(free))
                c = float(rng.uniform(low[f], high[f]))
                feature[k], cut[k] = f, c
                under, over = high.copy(), low.copy()
                under[f] = over[f] = c
                left[k] = node(low, under, level + 1)
                right[k] = node(over, high, level + 1)
            return k

        roots = [node(low, high, 0) for _ in range(trees)]
        return Forest(np.array(feature, dtype=np.int64), np.array(cut), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(levels, dtype=float), roots, 1e-9)

    def counted(self, rows: np.ndarray) -> Forest:
        """A plan with the rows of its leaves: a node of one row or none is a leaf, and rows of one leaf count for the
        splits that would part them."""
        rows = rows.copy()
        for k in range(len(rows) - 1, -1, -1):
            if self.feature[k] >= 0:
                rows[k] = rows[self.left[k]] + rows[self.right[k]]
        n = int(rows[self.roots[0]]) if self.roots else 0
        depth = self.depth + np.array([Forest._average_path(int(v)) for v in rows])
        return Forest(np.where(rows > 1, self.feature, -1), self.cut, self.left, self.right, depth, self.roots if n else [], max(Forest._average_path(n), 1e-9))

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of every row, tree by tree."""
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= self.cut[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            yield at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 0 to 1; shorter paths score higher."""
        if not self.roots or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for at in self.leaves(x):
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def calibrate(scored: DataFrame, max_false: float = MAX_FALSE_DROPS) -> float:
    """Scores above the result are anomalous: best difference of drop rates, with few false drops.

    scored has anomaly and y (1 for good) of all labelled rows; they are counted by score and summed by ranges of scores.
    """
    counts = scored.groupBy("anomaly").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") != 1).alias("bad"))
    placed = Scratch(scored.sparkSession, "rules").save(counts.repartitionByRange(F.desc("anomaly")).withColumn("p", F.spark_partition_id()), "scores")
    parts = sorted(placed.groupBy("p").agg(F.max("anomaly").alias("most"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: -r["most"])
    goods, bads = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    if not goods or not bads:
        return 2.0
    before, good, bad = {}, 0, 0
    for r in parts:
        before[r["p"]] = good, bad
        good, bad = good + r["good"], bad + r["bad"]

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("anomaly", ascending=False)
        good, bad = before[int(rows["p"].iloc[0])]
        false_rate, true_rate = (good + rows["good"].cumsum().to_numpy()) / goods, (bad + rows["bad"].cumsum().to_numpy()) / bads
        s = rows["anomaly"].to_numpy()
        gain = np.where(false_rate <= max_false, true_rate - false_rate, -1.0)
        at = int(np.argmax(gain))
        return pd.DataFrame({"gain": [gain[at]], "s": [s[at]], "below": [s[at + 1] if at + 1 < len(s) else -1.0]})

    found = placed.groupBy("p").applyInPandas(best, "gain double, s double, below double").where("gain > -1").collect()
    if not found:
        return 2.0
    gain, s, below = max((r["gain"], r["s"], r["below"]) for r in found)
    # the next score may lead another range
    below = max([below, *(r["most"] for r in parts if r["most"] < s)])
    return float((s + below) / 2) if below >= 0 else float(np.nextafter(s, -1))


_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def statistics(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (hash of id and text), the five counts and x (the statistics) of every document, as a written table."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, "text"):
            counts, stats = rule_counts(s.column(1))
            x = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), *(pa.array(c) for c in counts.T.copy()), x], names=["id", "row", *COUNTS, "x"])

    kind = documents.select(doc_id).schema[0].dataType.simpleString()
    given = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row"))
    out = given.mapInArrow(one, f"id {kind}, row long, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>")
    return Scratch(spark, "rules").save(out, "statistics")


def _numbers(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", trees: int = TREES, sample: int | None = None, depth: int = DEPTH) -> tuple[Forest, float]:
    """Grow the forest on all rows of written ``statistics`` that pass the base rule, and calibrate its threshold on all
    labelled ones; quality is 1 for good rows.

    With ``sample``, each tree is grown on so many rows of its own instead, of which the driver gets trees * sample.
    """
    spark = stats.sparkSession
    passed = stats.where(f"not ({_FAILED})").select("id", "row", "x")
    ends = passed.agg(*(f(F.get("x", F.lit(i))) for f in (F.min, F.max) for i in range(len(STATISTICS)))).first()
    low, high = np.array([0.0 if v is None else v for v in ends]).reshape(2, -1)
    if sample is None:
        sent = spark.sparkContext.broadcast(Forest.plan(low, high, trees, depth))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan = sent.value
            rows = np.zeros(len(plan.feature), dtype=np.int64)
            for b in batches:
                # most documents are within all rules and so alike
                distinct, n = np.unique(_numbers(b.column(0)), axis=0, return_counts=True)
                for at in plan.leaves(distinct):
                    np.add.at(rows, at, n)
            some = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some])], names=["leaf", "n"])

        rows = np.zeros(len(sent.value.feature), dtype=np.int64)
        for r in passed.select("x").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
            rows[r["leaf"]] = r["n"]
        forest = sent.value.counted(rows)
    else:
        grown = _numbers(bounded_rows(passed, ["row"], trees * sample, 1).select("x").toArrow().column("x").combine_chunks())
        forest = Forest.grow(grown[np.lexsort(grown.T)], low, high, trees, sample)
    named = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(quality).cast("int").alias("y"))
    return forest, calibrate(_scored(passed.join(named, "id").select("y", "x"), forest))


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """The rows with their anomaly score in place of x, their last column."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)
    names = [*rows.columns[:-1], "anomaly"]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            distinct, at = np.unique(_numbers(b.column(b.num_columns - 1)), axis=0, return_inverse=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sent.value.score(distinct)[at.ravel()])], names=names)

    return rows.mapInArrow(one, ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1]) + ", anomaly double")


def judge(stats: DataFrame, forest: Forest, threshold: float, *, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the five counts, the anomaly score, base_failed and kept for every row of written ``statistics``."""
    out = _scored(stats.select("id", *COUNTS, "x"), forest).withColumnRenamed("id", doc_id)
    return out.withColumn("base_failed", F.expr(_FAILED)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, the five counts, base_failed, kept; anomaly is the forest's score."""
    stats = statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judge(stats, *fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
