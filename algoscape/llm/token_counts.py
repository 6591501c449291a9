"""Token counts: pieces are counted once per distinct pre-token and summed over per-document frequencies.

A pre-token here is a run without ASCII white space, also cut where an ASCII letter or digit meets ASCII punctuation
other than ``' < | >``. The tokenizer's normaliser and splitter never join text across such places (contractions
start with ', special strings are made of the spared characters), so the tokens of a text are the sum of the tokens of
its pre-tokens, special strings included. Pre-tokens without < are lower-cased (A-Z), as the tokenizer does itself;
``cased=True`` leaves that out for tokenizers that keep case.

Three steps: distinct pre-tokens of all documents with their frequencies (each task forwards a pre-token once), pieces
of each distinct pre-token by the library, and the sum by document. No token id leaves the library call.

Pre-tokens are told apart by their bytes. Scans look them up by a 64-bit hash; the few hashes that two pre-tokens of the
table share are listed, and pre-tokens with such a hash are looked up by their bytes.

The piece table is broadcast while it has at most ``MAX_BROADCAST`` entries (12 bytes each; pre-tokens of one piece are
left out). Beyond that the most frequent entries are broadcast, and only the per-document frequencies of the rest are
joined with the table by a shuffle: rare pre-tokens, by definition few rows each.

Defined cases: null and empty texts have 0 bytes and 0 tokens; very long texts and pre-tokens are counted whole; repeated
rows are counted one by one; there are no ties; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from . import kernel as K
from .scratch import Scratch, bounded_batches

#: Entries of the broadcast piece table (12 bytes each).
MAX_BROADCAST = 5_000_000
#: Pre-tokens a task remembers as forwarded; beyond it may forward one again, which the shuffle removes.
_SEEN = 600_000
#: Pre-tokens in one call of the library.
_CALL = 4096

#: Byte classes: 0 white space, 1 ASCII letter or digit, 2 ASCII punctuation that is cut off, 3 all else.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = 0
_CLASS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = 2
#: Whether a pre-token starts, or the one before has ended, at a byte; by 4 * class of the byte before + own class.
_STARTS = np.array([p != c and c != 0 and (p == 0 or p + c == 3) for p in range(4) for c in range(4)])
_ENDS = np.array([p != c and p != 0 and (c == 0 or p + c == 3) for p in range(4) for c in range(4)])


def pretokens(column: pa.Array, cased: bool) -> K.Words:
    """Pre-tokens of a string array; equal hashes stand for equal piece counts."""
    buf, doc_byte = K.text_bytes(column)
    n = len(buf)
    pair = np.zeros(n + 1, dtype=np.uint8)
    pair[:-1] = _CLASS[buf]
    if n:
        last = pair[:-1].copy()
        pair[1:] += last * np.uint8(4)
        edges = doc_byte[(doc_byte > 0) & (doc_byte < n)]
        starts, ends = _STARTS[pair], _ENDS[pair]
        starts[edges], ends[edges] = last[edges] != 0, last[edges - 1] != 0
        start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    else:
        start = end = np.zeros(0, dtype=np.int64)
    h = K.span_hashes(buf, start, end, fold=not cased)
    if not cased and n and (angles := np.flatnonzero(buf == ord("<"))).size:
        odd = np.unique(np.searchsorted(end, angles, side="right"))
        h[odd] ^= K.span_hashes(buf, start[odd], end[odd], family=1)
    return K.Words(buf, doc_byte, start, end, h, np.searchsorted(start, doc_byte))


def distinct(w: K.Words, cased: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the pre-tokens by hash, and the places in it where another one begins.

    Pre-tokens of equal hash are one only if their lengths and their first and last eight bytes are equal too.
    """
    order = np.argsort(w.hash)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        eight, length = K.eights(w.buf, fold=not cased), w.end - w.start
        mask = K.FIRST[np.minimum(length, 8)]
        for x in (w.hash, length, eight[w.start] & mask, eight[np.maximum(w.end - 8, w.start)] & mask):
            y = x[order]
            same = y[1:] == y[:-1] if x is w.hash else same & (y[1:] == y[:-1])  # noqa: F821
        new[1:] = ~same
    return order, np.flatnonzero(new)


def _distinct(text: str, cased: bool):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            h, f = np.array(list(seen.values()), dtype=np.uint64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(K.signed(h.copy())), pa.array(list(seen), pa.binary()), pa.array(f.astype(np.int64))], names=["h", "piece", "f"])

        for s in K.slices(batches, text):
            w = pretokens(s.column(0), cased)
            order, head = distinct(w, cased)
            at = order[head]
            for h, piece, f in zip(w.hash[at].tolist(), pieces(w, at, cased), np.diff(np.append(head, len(order))).tolist(), strict=True):
                if piece in seen:
                    seen[piece][1] += f
                else:
                    seen[piece] = [h, f]
            if len(seen) > _SEEN:
                yield out()
                seen = {}
        yield out()

    return one


def pieces(w: K.Words, at: np.ndarray, cased: bool) -> list[bytes]:
    """The pre-tokens at the given places, as the piece table names them."""
    raw = w.buf.tobytes()
    cut = [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
    return cut if cased else [x if b"<" in x else x.lower() for x in cut]


def _count_pieces(path: str):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        for b in batches:
            own = b.column(1).to_pylist()
            n = np.zeros(len(own), dtype=np.int32)
            for i in range(0, len(own), _CALL):
                # one call for many pre-tokens: the space between them belongs to none
                texts = [x.decode() for x in own[i : i + _CALL]]
                start = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
                where = [o[0] for o in tok.encode(" ".join(texts), add_special_tokens=False).offsets]
                n[i : i + len(texts)] = np.bincount(np.searchsorted(start, where, side="right") - 1, minlength=len(texts)) if where else 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), b.column(2)], names=["h", "piece", "n", "f"])

    return one


def piece_table(documents: DataFrame, path: str, text: str = "text", cased: bool = False) -> DataFrame:
    """h, piece, n, f: hash, bytes, pieces and frequency of each distinct pre-token of the documents."""
    found = documents.select(text).mapInArrow(_distinct(text, cased), "h long, piece binary, f long")
    return found.groupBy("h", "piece").agg(F.sum("f").alias("f")).mapInArrow(_count_pieces(path), "h long, piece binary, n int, f long")


def _least_frequency(table: DataFrame, most: int) -> int:
    """A frequency such that the entries of it and above number at most ``most``: exact, or a power of two from 2**16 on."""
    cap = 1 << 16
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.col("f").cast("double")))).cast("long")
    steps = table.groupBy(F.when(F.col("f") < cap, F.col("f")).otherwise(power).alias("f")).count().orderBy(F.desc("f")).collect()
    total, least = 0, 2**63 - 1
    for f, n in steps:
        total += n
        if total > most:
            break
        least = f
    return least


def token_counts(documents: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", cased: bool = False, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document under the tokenizer file at ``path``."""
    spark = documents.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "tokens")
    full = scratch.save(piece_table(documents, path, text, cased), "pieces")
    # about n * n / 2**65 of n pre-tokens
    shared = np.sort(full.groupBy("h").count().where("count > 1").select("h").toArrow().column("h").to_numpy().view(np.uint64))
    table = full.where("n <> 1")
    whole = table.count() <= max_broadcast
    if not whole:
        table = full.where(F.col("f") >= _least_frequency(full, max_broadcast))
    got = table.select("h", "n").toArrow()
    keys = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], got.column("n").to_numpy()[order], shared))
    by_bytes = not whole or len(shared) > 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, shared = sent.value
        for s in K.slices(batches, text):
            w = pretokens(s.column(1), cased)
            order, head = distinct(w, cased)
            # distinct hashes in rising order walk through the table once
            at = order[head]
            h = w.hash[at]
            place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            found = keys[place] == h if len(keys) else np.zeros(len(h), dtype=bool)
            open_ = np.isin(h, shared) if whole else np.isin(h, shared) | ~found
            times = np.diff(np.append(head, len(order)))
            n = np.empty(len(order), dtype=np.int64)
            n[order] = np.repeat(np.where(open_, 0, np.where(found, counts[place] if len(keys) else 0, 1)), times)
            cols = [s.column(0), pa.array(np.diff(w.doc_byte)), pa.array(w.doc_sum(n), pa.int64())]
            if by_bytes:
                left = np.empty(len(order), dtype=bool)
                left[order] = np.repeat(open_, times)
                rest = np.flatnonzero(left)
                bounds = np.searchsorted(rest, w.first).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(pieces(w, rest, cased), pa.binary())))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "n_tokens", "rest"][: len(cols)])

    kind = documents.select(doc_id).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long"
    if not by_bytes:
        return documents.select(doc_id, text).mapInArrow(add, schema).withColumnRenamed("id", doc_id)
    # equal lists of pre-tokens, by a 128-bit hash, share one sum, whichever rows they come from
    key = ["k1", "k2"]
    rows = scratch.save(documents.select(doc_id, text).mapInArrow(add, f"{schema}, rest array<binary>"), "rows")
    rows = rows.withColumns({k: F.xxhash64(F.lit(i), "rest") for i, k in enumerate(key)})
    each = rows.where(F.size("rest") > 0).groupBy(*key).agg(F.first("rest").alias("rest")).select(*key, F.explode("rest").alias("piece"))
    sums = each.groupBy(*key, "piece").count().join(full.select("piece", "n"), "piece").groupBy(*key).agg(F.sum(F.col("count") * F.col("n")).alias("more"))
    total = F.col("n_tokens") + F.coalesce("more", F.lit(0))
    return rows.join(sums, key, "left").select(F.col("id").alias(doc_id), "n_bytes", total.alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_bytes, n_tokens, over_limit (more than 2048 tokens) with word_bpe_49k.json."""
    import public_tokenizers

    d = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
