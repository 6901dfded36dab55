"""What recurs in a corpus, found in packed column blocks.

An item (an n-gram, a line, an anchor) is a 64-bit hash. Its top bits name the
column block it belongs to, 32 more bits tell it from the others of its block.
A task gathers the items of a window of documents, folds those that recur there,
and sends one row for each block with the distinct items, sorted and as gaps. So
an exchange costs two or three bytes an item however many blocks there are, and
an item that very many documents share is sent once for a window, twice if it
recurs there. The owner of a block judges its items; those that it marks return
to the windows as a table that lies beside the documents (`beside`), where a
second scan finds them.

Blocks grow in number with the corpus up to 2**MOST_BITS, as many as an exchange
can have partitions. Beyond that, which is 1 TiB of text, items keep more bits, one for
each doubling, and the owner of a block works through it in ranges, so that the
work on one range and the chance that two items look alike stay the same at any
size. What an owner holds packed grows then, to about 1 GB at 100 TB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import beside
from tessera.llm.cluster import lean
from tessera.llm.textcore import Lookup

#: Bytes of text for each column block.
BLOCK_BYTES = 16 << 20
#: Items that a task gathers before it sends them.
BATCH_ITEMS = 1 << 21
#: Exponent of the number of column blocks, at most.
MOST_BITS = 16

PACKED = "file long, row long, block int, items binary, marks binary"
_PACKED = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("block", pa.int32()), ("items", pa.binary()), ("marks", pa.binary())])


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in docs."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


class Layout:
    """How many bits name a block, and how many more than 32 an item keeps within it."""

    def __init__(self, n_bytes: int, each: int = BLOCK_BYTES):
        wanted = max(3, (max(1, n_bytes - 1) // each).bit_length())
        self.bits = min(wanted, MOST_BITS)
        self.more = min(wanted - self.bits, 32 - self.bits)
        self.shift = np.uint64(32 - self.bits - self.more)

    @property
    def blocks(self) -> int:
        return 1 << self.bits

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The part of a hash that is kept: block, then 32 bits and `more`."""
        return hashes >> self.shift

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """ids as hashes with zeros for what isn't kept."""
        return ids << self.shift

    def distinct(self, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and distinct ids, sorted by owner, then id; owners of one chunk."""
        ids = self.ids(hashes)
        if int(owner.max(initial=0)) >> (int(self.shift)):  # owner and id don't fit into 64 bits
            order = np.lexsort((ids, owner))
            owner, ids = owner[order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
            return owner[new], ids[new]
        high = np.uint64(64) - self.shift
        both = (owner.astype(np.uint64) << high) | ids
        both.sort()
        both = both[np.diff(both, prepend=~both[:1]) != 0]
        return (both >> high).astype(np.int64), both & ((np.uint64(1) << high) - np.uint64(1))


def gaps(x: np.ndarray) -> bytes:
    """Sorted numbers of 64 bits as planes of the bytes of their gaps; upper planes are mostly zero and compress to nothing."""
    d = np.diff(x, prepend=np.uint64(0))
    k = max(1, -(-int(d.max(initial=0)).bit_length() // 8))
    return bytes([k]) + d.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    k = data[0]
    parts = np.frombuffer(data, np.uint8, offset=1).reshape(k, -1)
    d = np.zeros((parts.shape[1], 8), np.uint8)
    d[:, :k] = parts.T
    return np.cumsum(d.view(np.uint64)[:, 0], dtype=np.uint64)


def pack(file: int, window: int, ids: np.ndarray, layout: Layout) -> pa.RecordBatch:
    """A row for each block, with each item once, twice if it recurs."""
    ids.sort()
    again = np.zeros(len(ids), bool)
    again[2:] = (ids[2:] == ids[:-2])
    ids = ids[~again]
    low = np.uint64(32 + layout.more)
    block = (ids >> low).astype(np.int64)
    start = np.flatnonzero(np.diff(block, prepend=-1))
    ids &= (np.uint64(1) << low) - np.uint64(1)
    items = [gaps(part) for part in np.split(ids, start[1:])] if len(ids) else []
    n = len(items)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, file)), pa.array(np.full(n, window << beside.WINDOW)), pa.array(block[start].astype(np.int32)), pa.array(items, pa.binary()), pa.nulls(n, pa.binary())], schema=_PACKED)


def scatter(docs: DataFrame, items: Callable, layout: Layout) -> DataFrame:
    """Packed items of every window of docs, which have text, file and row. items(texts) gives the ids of an Arrow array of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None
        for file, window, b in beside.windows(batches):
            if held and (last != (file, window) or size > BATCH_ITEMS):
                yield pack(*last, np.concatenate(held), layout)
                held, size = [], 0
            last = (file, window)
            ids = items(b.column("text"))
            held.append(ids)
            size += len(ids)
        if held:
            yield pack(*last, np.concatenate(held), layout)

    return docs.select("file", "row", "text").mapInArrow(lean(run), PACKED)


def judge(packed: DataFrame, layout: Layout, verdict: Callable) -> DataFrame:
    """Distinct items that verdict(items) marks with more than 0 (an array of bytes, over all of a range's 32-bit items), packed as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        for b in batches:
            for file, row, block, items in zip(*(b.column(n).to_pylist() for n in ("file", "row", "block", "items")), strict=True):
                rows.setdefault(block, []).append((file, row, items))
        for block in list(rows):  # one, as blocks are partitions
            mine = rows.pop(block)
            parts = [from_gaps(r[2]) for r in mine]
            ends = np.cumsum([len(p) for p in parts])
            items = np.concatenate(parts)
            del parts
            low = items.astype(np.uint32)
            if layout.more:
                marks = np.zeros(len(items), np.uint8)
                of = (items >> np.uint64(32)).astype(np.uint32)
                for k in range(1 << layout.more):
                    at = np.flatnonzero(of == k)
                    marks[at] = verdict(low[at])
            else:
                marks = verdict(low)
            del low
            twice = items[1:] == items[:-1]
            twice[ends[:-1] - 1] = False
            marks[1:][twice] = 0  # the second of two
            out, a = [], 0
            for (file, row, _), z in zip(mine, ends.tolist(), strict=True):
                hit = np.flatnonzero(marks[a:z]) + a
                if len(hit):
                    out.append({"file": file, "row": row, "block": block, "items": gaps(items[hit]), "marks": marks[hit].tobytes()})
                a = z
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=_PACKED)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PACKED)

    return packed.repartitionById(layout.blocks, F.col("block")).mapInArrow(lean(run), PACKED)


class Marks:
    """What a worker reads of the judged items: those of the window that it is at."""

    def __init__(self, side: beside.Side, layout: Layout):
        self.side, self.layout = side, layout
        self.at: tuple[int, int] | None = None

    def __getstate__(self) -> dict:
        return {"side": self.side, "layout": self.layout, "at": None}

    def go(self, file: int, window: int) -> None:
        if self.at == (file, window):
            return
        self.at = (file, window)
        got = self.side.read(file, window)
        low = np.uint64(32 + self.layout.more)
        if got is None:
            ids, marks = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        else:
            got = got.sort_by("block")
            ids = np.concatenate([from_gaps(i) | (np.uint64(block) << low) for block, i in zip(got.column("block").to_pylist(), got.column("items").to_pylist(), strict=True)])
            marks = np.frombuffer(b"".join(got.column("marks").to_pylist()), np.uint8)
            if (ids[1:] <= ids[:-1]).any():  # a window that was sent in parts
                ids, first = np.unique(ids, return_index=True)
                marks = marks[first]
        self.table, self.marks = Lookup(self.layout.hashes(ids)), marks

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the ids that are marked, and their marks."""
        at, place = self.table.find(self.layout.hashes(ids))
        return at, self.marks[place]


def recurring(docs: DataFrame, items: Callable, layout: Layout, verdict: Callable, name: str) -> Marks:
    """The marked items of docs, which have text, file and row, laid beside them."""
    return Marks(beside.lay(judge(scatter(docs, items, layout), layout, verdict), name, layout.blocks), layout)
