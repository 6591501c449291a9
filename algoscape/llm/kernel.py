"""Vectorised word kernel over Arrow string batches.

All functions work on a whole slice of documents at once: the bytes of the slice are one numpy array, words are
found with byte-class tables, and every word, n-gram or window gets a 64-bit hash; each step of a hash is mixed, so that
no pattern of bytes or words makes hashes meet. No Python loop runs per word. Slices are cut by bytes, so memory is
bounded by the slice size or one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text per slice; one longer document is a slice of its own.
SLICE_BYTES = 1 << 19

_U = np.uint64
_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_LEFT, _LENGTH = _U(0x9FB21C651E98DF25), _U(0xA0761D6478BD642F)
#: Byte ranges over this length are hashed one by one.
_LONG = 256
#: Masks that keep the first 0..8 bytes of a little-endian word.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) ^ mix64(np.array([seed], dtype=_U)))


def _word_table(separators: bytes | None, letters: bytes | None) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    if separators is not None:
        t[:] = True
        t[list(separators)] = False
    else:
        t[list(letters)] = True
        t[128:] = True
    return t


#: Words split at ASCII white space: [^\x20\x09-\x0D]+
SPACED = _word_table(b" \t\n\x0b\x0c\r", None)
#: Words of digits, letters and all code points over 127: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = _word_table(None, b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Lines split at \n.
LINES = _word_table(b"\n", None)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a slice. ``first[d]:first[d+1]`` are the words of document d; start and end are byte offsets in buf."""

    buf: np.ndarray
    doc_byte: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc_sum(self, x: np.ndarray) -> np.ndarray:
        """Sum of a per-word array by document."""
        return span_sum(x, self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def doc_end(self) -> np.ndarray:
        """For each word, the index after its document's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def span_sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, dtype=np.float64 if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def find(buf: np.ndarray, doc_byte: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words and the first word of each document."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(doc_byte), dtype=np.int64)
    w = table[buf]
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = w
    after = before[1:].copy()
    edges = doc_byte[(doc_byte > 0) & (doc_byte < n)]
    start_mask = w & ~before[:-1]
    start_mask[edges] = w[edges]
    end_mask = np.empty(n, dtype=bool)
    end_mask[:-1] = after[:-1] & ~after[1:]
    end_mask[-1] = w[-1]
    end_mask[edges - 1] = w[edges - 1]
    start, end = np.flatnonzero(start_mask), np.flatnonzero(end_mask) + 1
    return start, end, np.searchsorted(start, doc_byte)


def eights(buf: np.ndarray, *, fold: bool = False) -> np.ndarray:
    """The eight bytes from each byte of buf on, as one little-endian word; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = _LOWER[buf] if fold else buf
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, *, fold: bool = False, family: int = 0) -> np.ndarray:
    """64-bit hash of each byte range: its bytes eight at a time, every step mixed before the next.

    The families are independent. Ranges of one length up to eight bytes never share a hash.
    """
    length = end - start
    seed = _U(_SEEDS[family])
    with np.errstate(over="ignore"):
        h = mix64(length.astype(_U) * _LENGTH + seed)
        if not len(h):
            return h
        eight = eights(buf, fold=fold)
        h = mix64(h ^ (eight[start] & FIRST[np.minimum(length, 8)]))
        at, done = np.flatnonzero((length > 8) & (length <= _LONG)), 8
        while len(at):
            h[at] = mix64(h[at] * _LEFT + (eight[start[at] + done] & FIRST[np.minimum(length[at] - done, 8)]))
            done += 8
            at = at[length[at] > done]
        for i in np.flatnonzero(length > _LONG).tolist():
            raw = buf[start[i] : end[i]]
            h[i] = xxhash.xxh3_64_intdigest((_LOWER[raw] if fold else raw).tobytes(), seed=int(seed))
    return h


def words(column: pa.Array, table: np.ndarray, *, fold: bool = False, family: int = 0) -> Words:
    """Find and hash the words of a string array; fold lower-cases A-Z first."""
    buf, doc_byte = text_bytes(column)
    start, end, first = find(buf, doc_byte, table)
    return Words(buf, doc_byte, start, end, span_hashes(buf, start, end, fold=fold, family=family), first)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * _LEFT + right)


class Runs:
    """Hashes of any run of consecutive words, from the words' hashes.

    Level k holds the hash of the 2**k words from each place on, joined from two halves. A run takes the two longest
    levels that start at its first and end at its last word, so equal runs have equal hashes wherever they stand.
    """

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_join(h[:-half], h[half:]))
        return self.levels[k]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start..end-1 of each run; runs hold a word at least."""
        length = end - start
        out = np.zeros(len(start), dtype=_U)
        if not len(out):
            return out
        k = np.frexp(length.astype(np.float64))[1] - 1
        for level in np.unique(k).tolist():
            h, at = self._level(level), slice(None) if k.min() == k.max() else np.flatnonzero(k == level)
            out[at] = _join(h[start[at]], h[end[at] - (1 << level)])
        with np.errstate(over="ignore"):
            return mix64(out ^ (length.astype(_U) * _LENGTH))

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k consecutive words; runs that cross documents are the caller's to mask."""
        i = np.arange(max(len(self.levels[0]) - k + 1, 0))
        return self.hashes(i, i + k)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; runs that cross documents are the caller's to mask."""
    return Runs(hashes).grams(k)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.diff(text_bytes(column)[1]))
        at, n = 0, batch.num_rows
        while at < n:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)
