"""Vectorised text primitives over Arrow string buffers.

A chunk of documents is one lower-cased byte buffer with offsets. Words are
maximal runs of ASCII letters, digits and any character outside ASCII; every
other character separates. Hashes are polynomial prefix sums modulo 2**64, so
the hash of any span costs two lookups, followed by a 64-bit finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words in SQL (RE2): regexp_extract_all(lower(text), WORD_SQL).
WORD_SQL = r"[a-z0-9\x{80}-\x{10FFFF}]+"

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = int(_rng.integers(2**40, 2**62)) * 2 + 1
_Q = int(_rng.integers(2**40, 2**62)) * 2 + 1
_Q2 = int(_rng.integers(2**40, 2**62)) * 2 + 1

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; of the inverse of base if asked."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        step = np.full(size, pow(base, -1, 2**64) if inverse else base, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 1 << 20:
            _powers[(base, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 19, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each and at most so many rows; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = string_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a chunk of texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts, "") if texts.null_count else texts)
        self.raw, self.offsets = string_buffer(low)
        n = len(self.raw)
        word = np.zeros(n + 2, dtype=bool)
        word[1:-1] = _WORD[self.raw]
        inside = word[1:-1]
        first = inside & ~word[:-2]
        last = inside & ~word[2:]
        cuts = self.offsets[:-1]
        cuts = cuts[cuts < n]
        first[cuts] = inside[cuts]
        ends = self.offsets[1:] - 1
        ends = ends[ends >= 0]
        last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, self.offsets)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.raw] * powers(_P, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(_P, n + 1, True)[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.doc)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts())

    def grams(self, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, their text, and the position of their first word in the chunk."""
        where = run_starts(self.doc, n)
        if not len(where):
            return np.zeros(0, np.uint64), where, where
        base = _Q2 if second else _Q
        hashes = span_hashes(self.hash, where, where + n, base)
        return hashes, np.searchsorted(self.doc, where, "right") - 1, where

    def text(self, a: int, b: int) -> str:
        """Lower-cased bytes from word a to word b, exclusive."""
        return self.raw[self.start[a] : self.end[b - 1]].tobytes().decode("utf-8", "replace")

    def word(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def run_starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive items fit within their document; doc: first item of each, and the end."""
    total = int(doc[-1])
    if total < n:
        return np.zeros(0, np.int64)
    fits = np.ones(total, dtype=bool)
    for k in range(1, n):
        at = doc[1:] - k
        fits[at[at >= doc[:-1]]] = False
    return np.flatnonzero(fits)


def span_hashes(items: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = _Q) -> np.ndarray:
    """Hash of each run items[a:b]."""
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * powers(base, len(items)), out=sums[1:])
    return mix((sums[b] - sums[a]) * powers(base, len(items) + 1, True)[a])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, as Spark stores them."""
    return x.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


_SHAPE = np.full(256, 5, dtype=np.uint8)
_SHAPE[[*range(97, 123)]] = 0
_SHAPE[[*range(65, 91)]] = 1
_SHAPE[[*range(48, 58)]] = 2
_SHAPE[[9, 10, 13, 32]] = 3
_SHAPE[[ord(c) for c in ".,;:'\"-()?"]] = 4
_SHAPE[128:] = 6
#: Kinds of bytes: small and capital letters, digits, space, usual punctuation, other symbols, beyond ASCII.
SHAPES = 7


def shapes(raw: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bytes of each kind for each of n owners."""
    return np.bincount(owner * SHAPES + _SHAPE[raw], minlength=n * SHAPES).reshape(n, SHAPES)


class Lookup:
    """Positions of 64-bit hashes in a sorted array, by a table on their top bits first."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bits = max(10, min(22, int(np.ceil(np.log2(max(1, len(values))))) + 5))
        self.shift = np.uint64(64 - self.bits)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(values >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of those hashes that are there, and their places among the values."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        right = self.values[place] == hashes[at]
        return at[right], place[right]
