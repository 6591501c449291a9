"""MinHash near-duplicates: universal hash minima, banding, signature checks, exact confirmation, components.

A document's set holds its distinct k-word shingles (lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``); with fewer words
the whole sequence is one shingle. Two documents are linked when 100 * |A and B| >= 100 * threshold * |A or B|.

1. One scan gives each document a 128-bit digest of its set and ``BANDS * ROWS`` universal hash minima (16 bits each).
2. Equal sets form a class, represented by its smallest id; only representatives go on, so copies cost nothing more.
3. Band keys make buckets. A bucket is not expanded into pairs: its members are compared with one leader, the member of
   least random rank, which is the same in most buckets that a group of near copies shares.
4. Only pairs whose one-bit minima agree well enough leave the bucket; they pass a length bound and a signature bound, then
   the full shingle sets confirm them, word by word. Links go through large-star/small-star steps. At the threshold, one-bit
   minima and signatures each fail a pair with probability ``MISS`` at most (exact binomial tails).
5. A bucket is settled when its other members lie in one component. The members of those that are not (many texts
   that share a passage, say) are joined exactly, without any cap: by shared shingles among the rarest that two sets of
   the threshold must share, with the bound on their overlap that the places of the shared shingle give, and only
   across components. Lengths that the bound allows are part of the join's key, and rows of the component that holds most
   rows of a shingle meet those of other components alone, so that texts of one template make no pairs.

At similarity 0.8 a pair misses all bands with probability (1 - 0.8**ROWS)**BANDS, 1.3e-7 with 40 bands of 5. Equal sets
are known by 128-bit digests from two independent hashes of their words; all other links are confirmed on words.

Defined cases: null and empty texts have an empty set and are linked with nothing; very long texts are read whole; a null
id is linked with nothing, gets a null component and is kept; rows that repeat an id are each returned with the id's
component, which with different texts under one id is that of one of them; a similarity equal to the threshold links; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from . import kernel as K
from .graph import connected_components
from .scratch import Scratch, bounded_batches

BANDS, ROWS = 40, 5
#: Ids broadcast at most (8 bytes each) to pick documents; beyond that the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: One-bit minima that travel with bucket members, three longs, for a first check where pairs are made.
BITS = 192
_WORDS = ["s0", "s1", "s2"]
#: Probability that the one-bit minima, or the signatures, of a pair right at the threshold fail it.
MISS = 1e-9
#: Earlier shingles that a shingle carries in the exact join of unsettled members.
BEFORE = 8


def shingles(column: pa.Array, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the documents one after the other, and the bounds of each document's."""
    w = K.words(column, K.SPACED, fold=True, family=family)
    docs, count = len(w.first) - 1, np.diff(w.first)
    start = np.arange(len(w.hash))
    end = w.doc_end()
    doc = w.doc_of()
    # a short document is one shingle, which starts at its first word
    whole = (count < k)[doc] if len(doc) else np.zeros(0, dtype=bool)
    ok = np.where(whole, start == w.first[:-1][doc], start + k <= end) if len(doc) else whole
    s = start[ok]
    h = K.Runs(w.hash).hashes(s, np.minimum(s + k, end[ok]))
    d = doc[ok]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(docs + 1))


def plain_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text, as their words."""
    words = text.encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)} if words else set()


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    n = BANDS * ROWS
    return K.random_words(n, 101) | np.uint64(1), K.random_words(n, 202)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of multiply-add-shift hashes, documents x (BANDS * ROWS); empty sets give zeros."""
    a, b = _coefficients()
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, len(a)), dtype=np.uint16)
    if len(full):
        at = bounds[:-1][full]
        x = h >> np.uint64(32)
        work = np.empty_like(x)
        with np.errstate(over="ignore"):
            for i in range(len(a)):
                np.multiply(x, a[i], out=work)
                np.add(work, b[i], out=work)
                out[full, i] = (np.minimum.reduceat(work, at) >> np.uint64(32)).astype(np.uint16)
    return out


def _sketch(k: int, text: str):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, text, 1 << 18):
            h, bounds = shingles(s.column(1), k)
            sig = signatures(h, bounds)
            digest = []
            with np.errstate(over="ignore"):
                for x, at in ((h, bounds), shingles(s.column(1), k, 1)):
                    c = np.zeros(len(x) + 1, dtype=np.uint64)
                    np.cumsum(K.mix64(x ^ np.uint64(0x6A09E667F3BCC909)), out=c[1:])
                    digest.append(pa.array(K.signed(c[at[1:]] - c[at[:-1]])))
            n = np.diff(bounds)
            flat = pa.py_buffer(np.ascontiguousarray(sig).tobytes())
            width = sig.shape[1] * 2
            offsets = pa.py_buffer((np.arange(len(n) + 1) * width).astype(np.int32).tobytes())
            bits = np.packbits((sig[:, :BITS] & 1).astype(np.uint8), axis=1).view(np.int64)
            whole = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, flat])
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), *digest, whole, *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], names=["id", "n", "d1", "d2", "sig", *_WORDS])

    return one


def _sets(k: int):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.slices(batches, "text"):
            h, bounds = shingles(s.column(1), k)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(K.signed(h)))
            yield pa.RecordBatch.from_arrays([s.column(0), sets], names=["id", "shingles"])

    return one


def _alike(least: int):
    """Keeps pairs whose signatures agree in at least ``least`` places."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
            keep = (x == y).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return one


def _confirm(k: int, percent: int):
    """Keeps pairs of texts whose full sets reach the threshold: by hashes first, then on the words themselves."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = lambda both, p, q: 100 * both >= percent * (p + q - both)
        of, own = None, set()
        for batch in batches:
            for b in K.slices(K.slices(iter([batch]), "text_a"), "text_b"):
                x, y = (shingles(b.column(i), k) for i in (2, 3))
                keep = np.zeros(b.num_rows, dtype=bool)
                for i in range(b.num_rows):
                    p, q = (h[at[i] : at[i + 1]] for h, at in (x, y))
                    if reach(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)):
                        if of != (a := b.column(0)[i].as_py()):
                            of, own = a, plain_shingles(b.column(2)[i].as_py(), k)
                        other = plain_shingles(b.column(3)[i].as_py(), k)
                        keep[i] = reach(len(own & other), len(own), len(other))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return one


def _picked(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents (id, text) with one of ``ids`` (id, a written table)."""
    return documents.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """u, v: the pairs (a, b) that bounds, signatures and full sets confirm."""
    places = BANDS * ROWS
    least = places - _most(places, 1 - percent / 100)
    x, y = (reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    near = pairs.join(y, "b").join(x, "a").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = near.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(least), "a long, b long")
    return _confirmed(near, texts, k, percent)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """u, v: the pairs (a, b) whose full sets reach the threshold."""
    x, y = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(y, "b").join(x, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "u long, v long")


#: Key of the exact join: shingle, length class, and whether the component with most rows of the shingle takes part.
MEET = ["s", "size", "top"]


def _prefix_sides(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Both sides of the exact join on MEET: rows of the longer set (a) and of the shorter (b), which may be equally long.

    A longer set of n shingles with the shared one at place p meets lengths from n * threshold to the least of n and
    (n - p) * (1 + threshold) / threshold - n, by classes of lengths that grow by a twentieth. Rows of the shingle's top
    component (top = 1) meet rows of the others (top = 0) only; rows of the others meet all.
    """
    t = percent / 100
    rows = members.join(sets, "id").select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    shared = rows.join(often, "s")
    of = Window.partitionBy("id")
    rising = of.orderBy("f", "s")
    # shingles of one member alone come before all shared ones
    place = F.col("n") - F.count("*").over(of) + F.row_number().over(rising) - 1
    placed = shared.withColumns({"p": place, "before": F.collect_list("s").over(rising.rowsBetween(-BEFORE, -1))})
    prefix = scratch.save(placed.where(f"p <= n - ceil(n * {percent} / 100)").select("s", "id", "c", "n", "p", "before"), "prefix")
    top = prefix.groupBy("s", "c").agg(F.count("*").alias("f")).groupBy("s").agg(F.max(F.struct("f", "c"))["c"].alias("c0"))
    marked = scratch.save(prefix.join(top, "s").withColumn("top", (F.col("c") == F.col("c0")).cast("int")).drop("c0"), "marked")
    cls = lambda n: F.floor(F.log(n.cast("double")) / F.lit(math.log(1.05)) + F.lit(1e-9)).cast("int")
    n, p = F.col("n"), F.col("p")
    longest = F.least(n, F.floor((n - p) * ((1 + t) / t) - n + 1e-6).cast("int"))
    shortest = F.ceil(n * t - 1e-6).cast("int")
    sizes = F.explode(F.sequence(cls(shortest), cls(longest)))
    a = marked.where(longest >= F.greatest(shortest, F.lit(1))).withColumn("size", sizes)
    a = a.withColumn("top", F.explode(F.when(F.col("top") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    b = marked.withColumn("size", cls(n))
    a, b = (x.select(*MEET, *(F.col(c).alias(f"{c}_{side}") for c in ("id", "c", "n", "p", "before"))) for x, side in ((a, "a"), (b, "b")))
    return a, b


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: pairs of members (id, c) of different components c that can reach the threshold.

    Shingles are ordered by their frequency among the members, rarest first. Two sets of the threshold share one of
    the first n - ceil(n * threshold) + 1 of each, and what follows the first shared place bounds their overlap. A pair
    that also shares one of the ``BEFORE`` shingles before was made there, where the bound is weaker, and is skipped.
    """
    a, b = _prefix_sides(members, sets, percent, scratch)
    fits = f"(n_a > n_b or n_a = n_b and id_a < id_b) and c_a <> c_b and {100 + percent} * least(n_a - p_a, n_b - p_b) >= {percent} * (n_a + n_b) and not arrays_overlap(before_a, before_b)"
    return a.join(b, MEET).where(fits).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _most(n: int, p: float) -> int:
    """Least number that n draws of probability p exceed with probability MISS at most."""
    tail, k = 0.0, n
    while k > 0 and tail + (one := math.comb(n, k) * p**k * (1 - p) ** (n - k)) <= MISS:
        tail, k = tail + one, k - 1
    return k


def _near_bits(a: str, b: str, percent: int):
    """Whether one-bit minima differ in few enough places: they agree with probability (1 + similarity) / 2."""
    most = _most(BITS, (1 - percent / 100) / 2)
    differ = [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _WORDS]
    return differ[0] + differ[1] + differ[2] <= most


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id) and kept for every document; ids are integers."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "near")
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = scratch.save(docs.mapInArrow(_sketch(k, "text"), "id long, n long, d1 long, d2 long, sig binary, s0 long, s1 long, s2 long"), "sketch")
    reps = scratch.save(sketch.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("sig", *_WORDS))), "reps")

    width = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(BANDS)))
    # u ranks the members of a bucket at random, alike in all buckets; bits holds their one-bit minima
    banded = reps.select("id", F.xxhash64("id", F.lit(5)).alias("u"), F.struct(*_WORDS).alias("bits"), F.explode(keys).alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("u", "id", "bits")).alias("lead")).where("size > 1")
    # written first: a join of written tables can split a band that very many documents share
    full = scratch.save(full, "buckets")
    members = scratch.save(banded.join(full, "key").select("key", "id", "u", "bits", "lead"), "members-0")
    texts = scratch.save(_picked(docs, scratch.save(members.select("id").distinct(), "ids")), "texts-all")
    # a repeated id has one text, any of its own
    texts = scratch.save(texts.dropDuplicates(["id"]), "texts") if _repeated(texts) else texts

    first = members.where("id <> lead.id").where(_near_bits("bits", "lead.bits", percent))
    pairs = scratch.save(first.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs-0")
    links = scratch.save(_links(pairs, reps, texts, k, percent), "links-0")
    labels = scratch.save(connected_components(links, scratch, "cc-0"), "labels-0")
    rest = members.where("u > lead.u").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    unsettled = rest.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    open_ = scratch.save(rest.join(unsettled, "key", "left_semi").select("id", "c").distinct(), "open")
    if not open_.isEmpty():
        sets = scratch.save(_picked(texts, open_.select("id").distinct()).select("id", "text").mapInArrow(_sets(k), "id long, shingles array<long>"), "sets")
        sides = Scratch(spark, "prefix")
        pairs = scratch.save(_prefix_pairs(open_, sets, percent, sides), "pairs-1")
        sides.clear()
        more = scratch.save(_confirmed(pairs, texts, k, percent), "links-1")
        if not more.isEmpty():
            labels = scratch.save(connected_components(links.unionByName(more), scratch, "cc-1"), "labels-1")

    for name in ("buckets", "members-0", "ids", "texts-all", "texts", "sets", "pairs-0", "pairs-1", "links-0", "links-1", "open"):
        scratch.drop(name)
    own = reps.select("d1", "d2", F.col("id").alias("rep")).join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = sketch.select("id", "n", "d1", "d2").join(own.select("d1", "d2", F.coalesce("component", "rep").alias("component")), ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return linked.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _repeated(rows: DataFrame) -> bool:
    """Whether an id stands on several rows."""
    return not rows.groupBy("id").count().where("count > 1").isEmpty()


def remove_near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that represent their group, all columns unchanged."""
    scratch = Scratch(documents.sparkSession, "dropped")
    found = near_duplicates(documents, doc_id=doc_id, text=text, k=k, percent=percent)
    gone = scratch.save(found.where("not kept").select(doc_id).distinct(), "ids")
    return documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, doc_id, "left_anti")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest over 4-word shingles: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
