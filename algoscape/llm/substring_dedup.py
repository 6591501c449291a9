"""Substring dedup over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged). Each word covered by a window whose word
sequence also starts in a document with a smaller id is removed. Windows are judged on the input.

The index does not hold every window. Each window is represented by an anchor: the ``GRAM``-word gram with the least
hash in it (winnowing), which depends on the window's words alone. Consecutive windows with one anchor form a span, whose
words have a digest from an independent hash family. An entry is (anchor, digest) -> its holder, the first place
of those words: the smallest (id, version of the text, first word, word after the last).

Runs are immutable bucketed tables sorted by their key: entries by (anchor, digest), and by anchor the least and largest
digest. A manifest in the index's folder names them, so another session can open the index. For a batch

1. its entries, made by one shuffle of the batch, are merge-joined with the runs bucket by bucket: history is read in
   its order and neither shuffled nor sorted. A span whose entry has a holder of smaller id is repeated as a whole.
2. An anchor with several digests is contested: its spans may share single windows. The windows of the first holder of
   each contested entry get 128-bit digests, and the first place of each digest decides.
3. Repeated stretches with one holder are put together and verified: the SHA-256 of the holder's words, made once for
   all documents that repeat them, is compared with that of the document's own, and only equal words are removed. A
   collision of the index's hashes can only keep words.
4. The batch becomes a run; ``FANOUT`` runs of a level are merged, bucket by bucket, into one of the next.

No pair of documents is ever formed, and hot passages are pre-aggregated to one entry. The texts of holders are read
again, from the tables they came from: by one scan of id and text for contested windows and one for verification, which
keep the holders alone.

Batches must come with ascending ids: history wins over a batch only through smaller ids.

Defined cases: null and empty texts, and texts under WINDOW words, lose nothing; very long texts are read whole; rows
with equal ids do not remove each other's words; of equal windows the smallest id holds, so there are no ties; rows
with a null id are never earlier than others and lose nothing; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from . import kernel as K
from .scratch import Scratch, bounded_batches, read_text, write_text

WINDOW, GRAM = 50, 10
#: Runs of one level before they are compacted.
FANOUT = 3
#: Batches of the query: the last one meets a compacted run.
BATCHES = 4
#: Rows of ids or anchors broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Beyond that, the documents that repeat one passage are dealt to so many tasks.
SALTS = 32
_LOW = 24


def anchors(w: K.Words, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a slice: anchor hash, digest (of word hashes ``other``), first window's word, word after the last window."""
    n, z = len(w.hash), np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return z.view(np.uint64), z.view(np.uint64), z, z
    g = K.gram_hashes(w.hash, GRAM)
    low = np.uint64((1 << _LOW) - 1)
    key = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    # least key of each run of `need` grams by doubling; equal hashes fall to the first
    need, have, least = WINDOW - GRAM + 1, 1, key
    while 2 * have <= need:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < need:
        rest = need - have
        least = np.minimum(least[:-rest], least[rest:])
    i = np.arange(len(least))
    ok = i + WINDOW <= w.doc_end()[: len(least)]
    i = i[ok]
    if not len(i):
        return z.view(np.uint64), z.view(np.uint64), z, z
    pos = i + ((least[ok] - i.astype(np.uint64)) & low).astype(np.int64)
    new = np.ones(len(i), dtype=bool)
    new[1:] = (pos[1:] != pos[:-1]) | (i[1:] != i[:-1] + 1)
    head = np.flatnonzero(new)
    first = i[head]
    after = np.append(i[head[1:] - 1], i[-1]) + WINDOW
    return g[pos[head]], K.Runs(other).hashes(first, after), first, after


def _words(column: pa.Array) -> tuple[K.Words, np.ndarray]:
    """Words and their hashes of the other family."""
    w = K.words(column, K.SPACED)
    return w, K.span_hashes(w.buf, w.start, w.end, family=1)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in K.slices(batches, "text"):
        w, other = _words(s.column(1))
        anchor, digest, first, after = anchors(w, other)
        doc = np.searchsorted(w.first, first, side="right") - 1
        base = w.first[doc]
        ids, version = s.column(0).take(pa.array(doc)), s.column(2).take(pa.array(doc))
        yield pa.RecordBatch.from_arrays(
            [ids, version, pa.array(K.signed(anchor)), pa.array(K.signed(digest)), pa.array((first - base).astype(np.int32)), pa.array((after - base).astype(np.int32))],
            names=["id", "version", "anchor", "digest", "first", "after"],
        )


_SPANS = "id long, version long, anchor long, digest long, first int, after int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit digests of the windows in the given spans (lists of first, after) of each text."""
    for s in K.slices(batches, "text"):
        w, other = _words(s.column(1))
        lists = [s.column(i) for i in (3, 4)]
        first, after = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        doc = np.repeat(np.arange(s.num_rows), lists[0].value_lengths().fill_null(0).to_numpy())
        count = after - first - WINDOW + 1
        doc = np.repeat(doc, count)
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        place = w.first[doc] + at
        place, which = np.unique(place, return_index=True)
        doc, at = doc[which], at[which]
        digests = [pa.array(K.signed(K.Runs(h).hashes(place, place + WINDOW))) for h in (w.hash, other)]
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([s.column(0).take(take), s.column(2).take(take), pa.array(at.astype(np.int32)), *digests], names=["id", "version", "first", "w1", "w2"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists of stretches with one holder and shift, put together where they touch: a row for each."""
    for b in batches:
        lists = b.column(b.schema.get_field_index("spans"))
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        first, after = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
        # rows are set apart, then the furthest end so far tells where a stretch begins
        gap = np.int64(1 << 32)
        reach = np.maximum.accumulate(after + row * gap)
        new = np.ones(len(row), dtype=bool)
        new[1:] = first[1:] + row[1:] * gap > reach[:-1]
        head = np.flatnonzero(new)
        row, first = row[head], first[head]
        after = reach[np.append(head[1:], len(reach)) - 1] - row * gap if len(head) else first
        cols = [b.column(b.schema.get_field_index(c)).take(pa.array(row)) for c in ("id", "version", "hid", "hversion")]
        hfirst = first + b.column(b.schema.get_field_index("shift")).to_numpy()[row]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(first.astype(np.int32)), pa.array((after - first).astype(np.int32)), pa.array(hfirst.astype(np.int32))], names=["id", "version", "hid", "hversion", "first", "n", "hfirst"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the asked words of holders, joined by one space; a text is split once for rows that follow each other."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)) for c in ("id", "version", "hfirst", "n")]
        of, words, found = None, [], []
        for text, id, version, first, n in zip(b.column(b.schema.get_field_index("text")).to_pylist(), *(c.to_pylist() for c in cols), strict=True):
            if of != (id, version):
                of, words = (id, version), text.encode().split()
            found.append(sha256(b" ".join(words[first : first + n])).digest())
        yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.binary())], names=["hid", "hversion", "hfirst", "n", "digest"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, words in verified stretches, and the other words of each document."""
    for s in K.slices(batches, "text"):
        kept, n, gone = [], [], []
        for text, stretches in zip(s.column(1).to_pylist(), s.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            n.append(len(words))
            if stretches:
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                for x in stretches:
                    if sha256(b" ".join(words[x["first"] : x["first"] + x["n"]])).digest() == x["digest"]:
                        mark[x["first"]] += 1
                        mark[x["first"] + x["n"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])


_RESULT = "id long, n_words long, n_removed long, kept_text string"
_HOLDER = "struct<id: bigint, version: bigint, first: int, after: int>"
_ENTRY, _KEY = ["anchor", "digest"], ["id", "version"]
_COLUMNS = {"entries": f"anchor BIGINT, digest BIGINT, holder {_HOLDER}, n BIGINT", "anchors": "anchor BIGINT, d0 BIGINT, d1 BIGINT"}
_SORTED = {"entries": _ENTRY, "anchors": ["anchor"]}


class FingerprintIndex:
    """Sorted immutable runs in a folder that the cluster shares, listed by level in its manifest.

    With ``path`` an index that is there is opened, else a new one is made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.scratch = Scratch(spark, "index", path)
        self.levels: list[list[str]] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a bucket is one file, so its order holds and merge joins need no sort
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        there = read_text(spark, self.scratch.path("manifest.json"))
        if there:
            found = json.loads(there)
            self.levels, self.buckets = found["levels"], found["buckets"]

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def read(self, run: str, kind: str) -> DataFrame:
        """The entries or anchors of a run, as a bucketed table of this session."""
        name = f"fingerprints_{run}_{kind}"
        if not self.spark.catalog.tableExists(name):
            by = ", ".join(_SORTED[kind])
            self.spark.sql(
                f"CREATE TABLE {name} ({_COLUMNS[kind]}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.scratch.path(f'{run}/{kind}')}'"
            )
        return self.spark.table(name)

    def _write(self, df: DataFrame, run: str, kind: str, grouped: bool) -> None:
        by = _SORTED[kind]
        # a shuffle that grouped rows by the key has dealt them like buckets, if there are as many of both
        if not grouped or int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            df = df.repartition(self.buckets, *by)
        df.write.format("parquet").bucketBy(self.buckets, by[0], *by[1:]).sortBy(by[0], *by[1:]).option("path", self.scratch.path(f"{run}/{kind}")).saveAsTable(f"fingerprints_{run}_{kind}")

    def write_run(self, entries: DataFrame, grouped: bool = False) -> str:
        """Write one immutable run of entries; a hot anchor's entries are dealt by their digests.

        ``grouped`` says that the entries come from a groupBy of their key over rows that are no buckets.
        """
        run = uuid.uuid4().hex
        self._write(entries, run, "entries", grouped)
        self._write(self.read(run, "entries").groupBy("anchor").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")), run, "anchors", True)
        return run

    def _drop(self, run: str) -> None:
        for kind in _COLUMNS:
            self.spark.sql(f"DROP TABLE IF EXISTS fingerprints_{run}_{kind}")
        self.scratch.drop(run)

    def append(self, run: str) -> None:
        """Add a written run, compact levels that are full, and only then replace the manifest and drop old runs."""
        old, level = [], 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                break
            full, self.levels[level] = self.levels[level], []
            old += full
            run = self.compact(full)
            level += 1
        write_text(self.spark, self.scratch.path("manifest.json"), json.dumps({"levels": self.levels, "buckets": self.buckets}))
        for r in old:
            self._drop(r)

    def compact(self, runs: list[str]) -> str:
        """One run of several, by full outer merge joins of their buckets."""
        both = self.read(runs[0], "entries")
        for r in runs[1:]:
            more = self.read(r, "entries").select(*_ENTRY, F.col("holder").alias("also"), F.col("n").alias("m"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            both = both.join(more.hint("merge"), _ENTRY, "full").select(*_ENTRY, F.least("holder", "also").alias("holder"), n.alias("n"))
        return self.write_run(both)

    def known(self, run: str) -> DataFrame:
        """The entries of a written run with their holder in it (own) and over all runs (holder)."""
        out = self.read(run, "entries").withColumn("own", F.col("holder"))
        for r in self.runs():
            more = self.read(r, "entries").select(*_ENTRY, F.col("holder").alias("also"))
            out = out.join(more.hint("merge"), _ENTRY, "left").select(*_ENTRY, "n", "own", F.least("holder", "also").alias("holder"))
        return out

    def contested(self, run: str) -> DataFrame:
        """Anchors of a written run that have several digests, in it or with all earlier runs."""
        out = self.read(run, "anchors")
        for r in self.runs():
            more = self.read(r, "anchors").select("anchor", F.col("d0").alias("e0"), F.col("d1").alias("e1"))
            out = out.join(more.hint("merge"), "anchor", "left").select("anchor", F.least("d0", "e0").alias("d0"), F.greatest("d1", "e1").alias("d1"))
        return out.where("d0 <> d1").select("anchor")

    def ingest(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Index a batch (id, text, version) and return its id, n_words, n_removed and kept_text.

        ``texts`` (id, text, version) must hold the texts of the batch and of everything ingested before, so that
        the words of holders can be read again.
        """
        scratch = Scratch(self.spark, "ingest")
        spans = scratch.save(batch.where("id is not null").mapInArrow(_spans, _SPANS), "spans")
        run = self.write_run(spans.groupBy(*_ENTRY).agg(F.min(F.struct("id", "version", "first", "after")).alias("holder"), F.count("*").alias("n")), grouped=True)
        known = scratch.save(self.known(run).where("n > 1 or holder.id < own.id").select(*_ENTRY, "holder"), "known")
        found = spans.join(known, _ENTRY).where("holder.id < id").select(*_KEY, "first", "after", "holder")

        contested = scratch.save(self.contested(run), "contested")
        if number := contested.count():
            at = F.broadcast(contested) if number <= BROADCAST_ROWS else contested
            every = reduce(DataFrame.unionByName, [self.read(r, "entries").join(at, "anchor", "left_semi") for r in [run, *self.runs()]])
            holders = scratch.save(every.groupBy(*_ENTRY).agg(F.min("holder").alias("holder")).select("holder.*"), "holders")
            lists = holders.groupBy(*_KEY).agg(F.collect_list("first").alias("firsts"), F.collect_list("after").alias("afters"))
            docs = texts.join(F.broadcast(lists) if holders.count() <= BROADCAST_ROWS else lists, _KEY).select("id", "text", "version", "firsts", "afters")
            windows = scratch.save(docs.mapInArrow(_windows, "id long, version long, first int, w1 long, w2 long"), "windows")
            least = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "version", "first")).alias("holder"), F.max("id").alias("most")).where("holder.id < most")
            # history has been judged; its ids are smaller than the batch's
            here = windows.where(F.col("id") >= spans.agg(F.min("id")).first()[0]) if self.runs() else windows
            single = here.join(least, ["w1", "w2"]).where("holder.id < id").select(*_KEY, "first", (F.col("first") + WINDOW).alias("after"), "holder")
            found = found.withColumn("holder", F.struct("holder.id", "holder.version", "holder.first")).unionByName(single)
        self.append(run)
        return self._verified(batch, texts, found, scratch)

    def _verified(self, batch: DataFrame, texts: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
        """The batch without the words of found stretches that equal their holder's."""
        rows = found.select(*_KEY, "first", "after", F.col("holder.id").alias("hid"), F.col("holder.version").alias("hversion"), (F.col("holder.first") - F.col("first")).alias("shift"))
        lists = rows.groupBy(*_KEY, "hid", "hversion", "shift").agg(F.array_sort(F.collect_list(F.struct("first", "after"))).alias("spans"))
        wanted = scratch.save(lists.mapInArrow(_merged, "id long, version long, hid long, hversion long, first int, n int, hfirst int"), "stretches")
        for name in ("spans", "known", "contested", "holders", "windows"):
            scratch.drop(name)
        # a passage is asked for once, however many documents repeat it
        place = ["hid", "hversion", "hfirst", "n"]
        asked = wanted.select(*place).distinct()
        few = wanted.count() <= BROADCAST_ROWS
        few_asked = few or asked.count() <= BROADCAST_ROWS
        at = asked.select(F.col("hid").alias("id"), F.col("hversion").alias("version"), "hfirst", "n")
        # few rows are sent to all tasks; the texts then stay where they are
        held = texts.join(F.broadcast(at), _KEY) if few_asked else texts.join(at.select(*_KEY).distinct(), _KEY, "left_semi").join(at, _KEY)
        digests = held.mapInArrow(_digests, "hid long, hversion long, hfirst int, n int, digest binary").distinct()
        if few_asked:
            checked = wanted.join(F.broadcast(digests), place)
        else:  # a hot passage's documents are dealt to SALTS tasks
            salted = wanted.withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(SALTS)).cast("int"))
            checked = salted.join(digests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*place, "salt"])
        stretches = checked.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "n", "digest")).alias("stretches"))
        ids = wanted.select(*_KEY).distinct()
        ids = F.broadcast(ids) if few else ids
        cut = batch.join(ids, _KEY, "left_semi").join(stretches, _KEY).select("id", "text", "stretches")
        # written here, so that what the batches return can be put together in one small plan
        cut = scratch.save(cut.mapInArrow(_apply, _RESULT), "cut")
        none = F.lit(None).cast("array<struct<first: int, n: int, digest: binary>>")
        plain = batch.join(ids, _KEY, "left_anti").select("id", "text", none.alias("stretches"))
        return cut.unionByName(plain.mapInArrow(_apply, _RESULT))


def remove_repeated_passages(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every document.

    The table is ingested in ``batches`` steps of ascending id ranges; ids are integers.
    """
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).withColumn("version", F.xxhash64("text"))
    low, high = docs.agg(F.min("id"), F.max("id")).first()
    index = FingerprintIndex(spark)
    nothing = F.lit(None).cast("array<struct<first: int, n: int, digest: binary>>")
    parts = [docs.where("id is null").select("id", "text", nothing.alias("stretches")).mapInArrow(_apply, _RESULT)]
    if low is not None:
        width = -(-(high - low + 1) // batches)
        for start in range(low, high + 1, width):
            parts.append(index.ingest(docs.where(f"id >= {start} and id < {start + width}"), docs.where(f"id < {start + width}")))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", doc_id)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_words, n_removed, kept_sha256."""
    d = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
