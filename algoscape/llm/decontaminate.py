"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is looked up in every token window.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The windows of an item are its runs of ``n``
words; an item of fewer words, but not none, is one window. Hash hits are verified against the words themselves.

The benchmark is dealt to shards of about ``SHARD_BYTES`` of text by a hash of its rows. An executor's task makes each
shard's window set: the item texts, and for each window its hash and its place in them, sorted by hash: about 4 bytes for
each byte of text. The driver gets and broadcasts one set at a time. The scan of the documents is narrow; ``SHARDS_PER_SCAN``
sets are looked up in one scan, and a larger benchmark costs further scans.

Defined cases: null or empty texts have no words; very long texts are read whole, and one longer item makes its shard
longer; items without words match nothing; an item whose id is null hits words but is not listed; repeated document rows
are judged one by one; repeated item rows count once; items that share a window are all listed; an empty documents or
benchmark table gives an empty result or no hits. Only the named columns are read; documents that already have ``__n_words``,
``__hit`` or ``__items`` raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship_package
from . import kernel as K
from .scratch import Scratch, bounded_batches, refuse

#: Benchmark text in one broadcast shard, and shards looked up in one scan.
SHARD_BYTES = 16 << 20
SHARDS_PER_SCAN = 4
_FILTER_BITS = 20


@dataclass
class WindowSet:
    """Windows of one shard: the items' words, and by window length the sorted hashes and first words of the windows."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    items: list[str | None]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def build(items: list[str | None], texts: pa.Array, n: int) -> WindowSet:
        w = K.words(texts, K.ALNUM, fold=True)
        count = np.diff(w.first)
        out = WindowSet(w.buf, w.start.astype(np.int32), w.end.astype(np.int32), w.first, items)
        runs, size_of, at = K.Runs(w.hash), np.minimum(count, n)[w.doc_of()], np.arange(len(w.hash))
        fits = at + size_of <= w.doc_end()
        for size in np.unique(size_of[fits]).tolist():
            i = at[fits & (size_of == size)]
            h = runs.hashes(i, i + size)
            order = np.argsort(h, kind="stable")
            out.by_length[size] = (h[order], i[order].astype(np.int32))
        return out

    def _window(self, i: int, size: int) -> list[bytes]:
        return [self.buf[a:b].tobytes().lower() for a, b in zip(self.start[i : i + size], self.end[i : i + size], strict=True)]

    def scan(self, w: K.Words, runs: K.Runs) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words lie in a verified window, and the item ids by document of the slice."""
        n = len(w.hash)
        mark = np.zeros(n + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        if not n:
            return mark[:0] > 0, items
        end, doc = w.doc_end(), w.doc_of()
        shift = np.uint64(64 - _FILTER_BITS)
        for size, (hashes, place) in self.by_length.items():
            if n < size:
                continue
            i = np.arange(n - size + 1)
            g = runs.hashes(i, i + size)
            near = np.zeros(1 << _FILTER_BITS, dtype=bool)
            near[hashes >> shift] = True
            i = np.flatnonzero(near[g >> shift])
            i = i[i + size <= end[i]]
            low, high = np.searchsorted(hashes, g[i]), np.searchsorted(hashes, g[i], side="right")
            for p, a, b in zip(i[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                words = [w.text(j).lower() for j in range(p, p + size)]
                equal = [k for k in place[a:b].tolist() if self._window(k, size) == words]
                if equal:
                    mark[p] += 1
                    mark[p + size] -= 1
                    own = items.setdefault(int(doc[p]), set())
                    own.update(x for k in equal if (x := self.items[int(np.searchsorted(self.first, k, side="right")) - 1]) is not None)
        return np.cumsum(mark[:-1]) > 0, items


_SHARD = "kind string, size int, data binary"


def _build(n: int):
    """The window set of all rows of a task, as named arrays."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        table = pa.Table.from_batches(rows) if rows else pa.table({"item": pa.array([], pa.string()), "text": pa.array([], pa.string())})
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        found = WindowSet.build(table.column("item").to_pylist(), texts, n)
        named = [("buf", 0, found.buf), ("start", 0, found.start), ("end", 0, found.end), ("first", 0, found.first)]
        named += [(kind, size, x) for size, both in found.by_length.items() for kind, x in zip(("hash", "place"), both, strict=True)]
        for kind, size, x in named:
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([size], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["kind", "size", "data"])
        for item in found.items:
            yield pa.RecordBatch.from_arrays([pa.array(["item"]), pa.array([0], pa.int32()), pa.array([None if item is None else item.encode()], pa.binary())], names=["kind", "size", "data"])

    return one


def _shards(benchmark: DataFrame, item: str, text: str, n: int) -> Iterator[WindowSet]:
    """The benchmark's window sets, each made by one task."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    rows = Scratch(benchmark.sparkSession, "benchmark").save(rows, "rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-size // SHARD_BYTES))
    for shard in range(number):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == shard)
        got = own.coalesce(1).mapInArrow(_build(n), _SHARD).toArrow()
        parts: dict[tuple[str, int], bytes] = {}
        items: list[str | None] = []
        for kind, size, data in zip(*(c.to_pylist() for c in got.columns), strict=True):
            if kind == "item":
                items.append(None if data is None else data.decode())
            else:
                parts[kind, size] = data
        kinds = {"buf": np.uint8, "start": np.int32, "end": np.int32, "first": np.int64, "hash": np.uint64, "place": np.int32}
        array = {k: np.frombuffer(v, dtype=kinds[k[0]]) for k, v in parts.items()}
        by_length = {size: (array["hash", size], array["place", size]) for kind, size in array if kind == "hash"}
        if by_length:
            yield WindowSet(array["buf", 0], array["start", 0], array["end", 0], array["first", 0], items, by_length)


_HITS = T.StructType(
    [
        T.StructField("__n_words", T.LongType()),
        T.StructField("__hit", T.ArrayType(T.IntegerType())),
        T.StructField("__items", T.ArrayType(T.StringType())),
    ]
)


def scan(documents: DataFrame, benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", n: int = 10, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of documents with __n_words, __hit (word ranges [from, to, from, to, ...]) and __items (ids)."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    refuse(documents, *_HITS.names)
    keep = documents.columns if keep is None else keep
    cols = list(dict.fromkeys([*keep, text]))
    out = documents.select(*cols)
    scratch = Scratch(spark, "scan")
    sets = _shards(benchmark, item_id, "text", n)
    number, more = 0, True
    while more:
        sent = []
        while len(sent) < SHARDS_PER_SCAN and more:
            found = next(sets, None)
            more = found is not None
            if more:
                sent.append(spark.sparkContext.broadcast(found))
        if sent or not number:
            # between two scans the rows and what is found so far are written
            out = scratch.save(out, f"scan-{number}") if number else out
            out = out.mapInArrow(_scan(cols, text, sent, number > 0), out.schema if number else T.StructType([*out.schema.fields, *_HITS.fields]))
            number += 1
    return out.select(*keep, *_HITS.names)


def _scan(cols: list[str], text: str, sent: list, again: bool):
    """Looks up the broadcast sets in each slice; ``again`` adds to what an earlier scan found."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            w = K.words(s.column(s.schema.get_field_index(text)), K.ALNUM, fold=True)
            runs = K.Runs(w.hash)
            hit, items = np.zeros(len(w.hash), dtype=bool), {}
            for x in sent:
                more, own = x.value.scan(w, runs)
                hit |= more
                for d, ids in own.items():
                    items.setdefault(d, set()).update(ids)
            hits, ids = [], []
            before = [s.column(s.schema.get_field_index(c)).to_pylist() for c in ("__hit", "__items")] if again else None
            any_ = K.span_sum(hit.astype(np.int64), w.first)
            for d in range(s.num_rows):
                found = items.get(d, set())
                if before and before[0][d]:
                    found = found | set(before[1][d])
                    for a, b in zip(before[0][d][::2], before[0][d][1::2], strict=True):
                        hit[w.first[d] + a : w.first[d] + b] = True
                    any_[d] += 1
                mask = hit[w.first[d] : w.first[d + 1]]
                hits.append(np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist() if any_[d] else [])
                ids.append(sorted(found))
            base = [s.column(i) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*base, pa.array(np.diff(w.first), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], names=[*cols, *_HITS.names])

    return one


def contamination(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 10) -> DataFrame:
    """Per document: id, n_words, n_hit, hit word ranges, item ids and whether any word is hit."""
    d = scan(documents, benchmark, text=text, n=n, keep=[doc_id])
    at = F.col("__hit")
    n_hit = F.aggregate(F.transform(at, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(doc_id, F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), at.alias("hit_ranges"), F.col("__items").alias("items"), (F.size(at) > 0).alias("contaminated"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", n: int = 10) -> DataFrame:
    """The documents without any benchmark window, all columns unchanged."""
    d = scan(documents, benchmark, text=text, n=n)
    return d.where(F.size("__hit") == 0).select(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", n: int = 10) -> DataFrame:
    """All documents; the hit words, and what stands between hit words of one range, are cut from the text."""
    d = scan(documents, benchmark, text=text, n=n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text):
            at = s.schema.get_field_index(text)
            w = K.words(s.column(at), K.ALNUM, fold=True)
            texts = s.column(at).to_pylist()
            for d, ranges in enumerate(s.column(s.schema.get_field_index("__hit")).to_pylist()):
                if not ranges:
                    continue
                raw, base, first, parts, done = texts[d].encode(), w.doc_byte[d], w.first[d], [], 0
                for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                    parts.append(raw[done : w.start[first + a] - base])
                    done = w.end[first + b - 1] - base
                texts[d] = b"".join([*parts, raw[done:]]).decode()
            cols = [s.column(i) if i != at else pa.array(texts, s.schema.field(at).type) for i in range(s.num_columns - len(_HITS.names))]
            yield pa.RecordBatch.from_arrays(cols, names=s.schema.names[: len(cols)])

    return d.mapInArrow(cut, documents.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    d = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.concat_ws(",", F.array_sort("items"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bg),
dg AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS g
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT d.doc_id, d.p, d.size, b.item_id FROM dg d JOIN bg b ON d.size = b.size AND d.g = b.g),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words h ON h.doc_id = dw.doc_id LEFT JOIN hit_items i ON i.doc_id = dw.doc_id
"""
