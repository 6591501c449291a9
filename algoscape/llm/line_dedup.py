"""Line dedup: lines that spread over many sites are boilerplate and leave every document.

A line is a ``\\n``-separated part of the text; it counts without ASCII white space at its ends, and lines of white space
alone stay. The spread of a line is the number of distinct sites (sources) whose documents hold it.

1. One scan lists (key, site) pairs, each once per slice of texts; the key is a 128-bit hash of the line.
2. Lines on one site alone, nearly all of them, leave by the least and largest site hash of their key.
3. HyperLogLog sketches of the other lines' sites are built per task and merged by aggregation, so a line that stands in
   a third of all documents shuffles one sketch per task. Estimates within ``NEAR`` of the limit get an exact distinct
   count, from the (key, site) pairs of those lines alone; the others are decided by the estimate.
4. A second scan fetches the boilerplate lines themselves. Lines are removed only where their bytes are equal.

The boilerplate lines are broadcast while they have at most ``MAX_BROADCAST_BYTES``; then removal is one narrow scan.
Beyond that they are joined with the documents' lines by a shuffle.

Defined cases: null and empty texts have no lines that count and are returned as they are; very long texts and lines are
read whole; a null site is no site; repeated rows add no site; a spread equal to the limit is boilerplate; an empty table
gives an empty result; further columns are passed on unread, but ``__n_lines``, ``__n_removed`` and ``__lines``, which
documents may not have, raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship_package
from . import kernel as K
from .scratch import Scratch, bounded_batches, refuse

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Sketches of 2**LG_K registers; their relative error is about 1.04 / sqrt(2**LG_K), 3.3 % for 10.
LG_K = 10
#: Estimates within this share of the limit are counted exactly: over six standard errors.
NEAR = 0.2
#: Keys (16 bytes each) and bytes of lines broadcast at most.
MAX_BROADCAST_KEYS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
_KEY = ["k1", "k2"]


class Lines:
    """Lines of a slice: byte ranges and document bounds, and of those with a word the bytes without outer white space."""

    def __init__(self, column: pa.Array):
        self.buf, self.doc_byte = K.text_bytes(column)
        self.start, self.end, self.first = K.find(self.buf, self.doc_byte, K.LINES)
        start, end, _ = K.find(self.buf, self.doc_byte, K.SPACED)
        a, b = np.searchsorted(start, self.start), np.searchsorted(end, self.end, side="right")
        self.held = b > a
        a, b = a[self.held], b[self.held] - 1
        raw = self.buf.tobytes()
        self.text = [raw[i:j] for i, j in zip(start[a].tolist(), end[b].tolist(), strict=True)]
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[self.held]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit hash of each line, as two words."""
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.text)), dtype=np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def _sites(text: str):
    """k1, k2, site: each pair once per slice."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            lines = Lines(s.column(0))
            codes = s.column(1).dictionary_encode()
            site = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)[lines.doc]
            at = np.flatnonzero(site >= 0)
            pairs = dict(zip(zip((lines.text[i] for i in at.tolist()), site[at].tolist(), strict=True), at.tolist(), strict=True))
            at = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
            k1, k2 = lines.keys()
            yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), codes.dictionary.take(pa.array(site[at]))], names=[*_KEY, "site"])

    return one


def _listed(text: str, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """k1, k2, line: the chosen lines, each once per slice."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            lines = Lines(s.column(0))
            k1, k2 = lines.keys()
            found = {lines.text[i]: i for i in np.flatnonzero(chosen(k1, k2)).tolist()}
            at = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(list(found), pa.binary())], names=[*_KEY, "line"])

    return one


def boilerplate(documents: DataFrame, *, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, max_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """line (bytes) of every line that stands on at least ``min_sites`` sites."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "lines")
    pairs = scratch.save(documents.select(text, F.col(site).cast("string").alias("site")).mapInArrow(_sites(text), "k1 long, k2 long, site string"), "pairs")
    sites = pairs.withColumn("h", F.xxhash64("site")).groupBy(*_KEY).agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    # lines on one site are decided without a sketch; sites that share a hash would only matter beside no other site
    several = scratch.save(sites.where("h0 <> h1" if min_sites > 1 else "true").select(*_KEY), "several")
    some = pairs.join(F.broadcast(several) if several.count() <= max_keys else several, _KEY, "left_semi")
    sketches = some.groupBy(*_KEY).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = sketches.select(*_KEY, F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR))
    spread = scratch.save(spread, "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select(*_KEY)
    exact = some.join(near, _KEY, "left_semi").distinct().groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select(*_KEY)
    keys = scratch.save(sure.unionByName(exact.select(*_KEY)), "keys")
    # the lines of these keys, from the texts
    kind, texts = "k1 long, k2 long, line binary", documents.select(text)
    if keys.count() <= max_keys:
        got = keys.toArrow()
        k1, k2 = (got.column(c).to_numpy() for c in _KEY)
        order = np.argsort(k1, kind="stable")
        sent = spark.sparkContext.broadcast((k1[order], frozenset(zip(k1.tolist(), k2.tolist(), strict=True))))

        def chosen(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
            first, both = sent.value
            hit = np.zeros(len(k1), dtype=bool)
            if len(first):
                at = np.flatnonzero(first[np.minimum(np.searchsorted(first, k1), len(first) - 1)] == k1)
                hit[at] = [x in both for x in zip(k1[at].tolist(), k2[at].tolist(), strict=True)]
            return hit

        lines = texts.mapInArrow(_listed(text, chosen), kind)
    else:
        lines = texts.mapInArrow(_listed(text, lambda k1, k2: np.ones(len(k1), dtype=bool)), kind).join(keys, _KEY, "left_semi")
    out = scratch.save(lines.select("line").distinct(), "lines")
    for name in ("pairs", "several", "spread", "keys"):
        scratch.drop(name)
    return out


_COUNTS = [T.StructField("__n_lines", T.LongType()), T.StructField("__n_removed", T.LongType())]


def _cut(text: str, known: Callable[[pa.RecordBatch, Lines], list[int]]):
    """Cuts the lines whose places ``known`` gives, and counts."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            at = s.schema.get_field_index(text)
            lines = Lines(s.column(at))
            gone = known(s, lines)
            removed = np.bincount(lines.doc[gone], minlength=s.num_rows) if gone else np.zeros(s.num_rows, dtype=np.int64)
            column = s.column(at)
            if gone:
                texts = column.to_pylist()
                which = np.flatnonzero(lines.held)[gone]
                base = lines.doc_byte[lines.doc[gone]]
                cuts: dict[int, list[tuple[int, int]]] = {}
                for d, a, b in zip(lines.doc[gone].tolist(), (lines.start[which] - base).tolist(), (lines.end[which] - base).tolist(), strict=True):
                    cuts.setdefault(d, []).append((a, b))
                for d, ranges in cuts.items():
                    raw, parts, done = texts[d].encode(), [], 0
                    for a, b in ranges:
                        # the line goes with the \n after it, or at the text's end with the one before it
                        parts.append(raw[done:a])
                        done = min(b + 1, len(raw))
                    kept = b"".join([*parts, raw[done:]])
                    if ranges[-1][1] == len(raw) and kept.endswith(b"\n"):
                        kept = kept[:-1]
                    texts[d] = kept.decode()
                column = pa.array(texts, s.schema.field(at).type)
            cols = [column if i == at else s.column(i) for i in range(s.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(lines.first), pa.int64()), pa.array(removed, pa.int64())], names=[*s.schema.names, "__n_lines", "__n_removed"])

    return one


def cut_lines(
    documents: DataFrame, *, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, max_keys: int = MAX_BROADCAST_KEYS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """The documents without boilerplate lines, all columns, with __n_lines (not empty ones) and __n_removed."""
    spark = documents.sparkSession
    refuse(documents, "__n_lines", "__n_removed", "__lines")
    lines = boilerplate(documents, text=text, site=site, min_sites=min_sites, max_keys=max_keys)
    if (lines.agg(F.sum(F.octet_length("line") + 64)).first()[0] or 0) <= max_bytes:
        sent = spark.sparkContext.broadcast(frozenset(lines.toArrow().column("line").to_pylist()))

        def known(_: pa.RecordBatch, lines: Lines) -> list[int]:
            common = sent.value
            return [i for i, x in enumerate(lines.text) if x in common]

        return documents.mapInArrow(_cut(text, known), T.StructType([*documents.schema.fields, *_COUNTS]))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            found = Lines(s.column(0))
            each = dict.fromkeys(zip(found.doc.tolist(), found.text, strict=True))
            keys = s.column(1).take(pa.array([d for d, _ in each], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in each], pa.binary()), keys], names=["line", "__key"])

    # texts that share a key share the list of their lines; each still loses only lines equal to listed ones
    key = F.xxhash64(text)
    held = documents.select(text, key.alias("__key")).mapInArrow(listed, "line binary, __key long").distinct().join(lines, "line")
    own = held.groupBy("__key").agg(F.collect_list("line").alias("__lines"))
    plain = documents.columns
    given = documents.withColumn("__lines", key).join(own.withColumnRenamed("__lines", "__found"), F.col("__lines") == F.col("__key"), "left")
    given = given.select(*plain, F.col("__found").alias("__lines"))

    def given_lines(s: pa.RecordBatch, lines: Lines) -> list[int]:
        own = [frozenset(x or ()) for x in s.column(s.schema.get_field_index("__lines")).to_pylist()]
        return [i for i, (d, x) in enumerate(zip(lines.doc.tolist(), lines.text, strict=True)) if x in own[d]]

    out = given.mapInArrow(_cut(text, given_lines), T.StructType([*given.schema.fields, *_COUNTS]))
    return out.drop("__lines")


def remove_boilerplate(documents: DataFrame, *, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with boilerplate lines cut from their text; other columns unchanged."""
    return cut_lines(documents, text=text, site=site, min_sites=min_sites).select(*documents.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with other than nothing in them), n_removed and kept_sha256 (of the text that is left)."""
    d = cut_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return d.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), kept.alias("kept_sha256"))


OP2_SQL = f"""
WITH lines AS (
  SELECT r, doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents))),
common AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, CAST(count(*) FILTER (line <> '') AS BIGINT) AS n_lines, CAST(count(c.k) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c ON c.k = lines.k GROUP BY r, doc_id
"""
