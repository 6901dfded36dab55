"""Exact deduplication by owners that hold Patricia tries.

Texts go to owners by their length and content hash. An owner inserts the full
bytes of each into a compressed radix trie, so equality is decided by bytes and
never by a hash. A terminal node holds the smallest identifier that arrived with
its text, and where its texts came from. If a trie outgrows its bound, its
largest subtree is written to the shared folder; later texts on that path
follow it there, and it is built anew, by itself, when the rest is done. What is
spilled is never all that the trie holds, so each rebuilding has less to do.

Before the exchange a task folds the equal texts of a stretch of documents and
sends one with the smallest identifier, so a text with very many copies comes to
its owner once for each stretch. Owners of texts with copies are laid beside the
documents (`beside`), and a second scan names the copies; there a text is found
by its address, 128 bits of hash within the stretch.

Defined results. One row for every row that isn't the one that stays; a doc_id
that is repeated with the same text gives a row naming itself. Null texts are
never copies of anything; empty texts are copies of each other. A null doc_id
comes after all others and is named as null. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import beside, blocks
from tessera.llm.cluster import batch, lean, shared_dir, small_batches

#: Bytes of text and of addresses that one trie may hold before it spills a subtree.
TRIE_BYTES = 192 << 20
#: Bytes of text within which a task folds equal texts before the exchange.
FOLD_BYTES = 8 << 20

FOLDED = "file long, row long, n_bytes long, h long, g long, content binary, none boolean, id long, at_row long, n long"
_FOLDED = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("content", pa.binary()), ("none", pa.bool_()), ("id", pa.int64()), ("at_row", pa.int64()), ("n", pa.int64())])
OWNED = "file long, row long, h long, g long, owner_id long, at_file long, at_row long"
_OWNED = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("owner_id", pa.int64()), ("at_file", pa.int64()), ("at_row", pa.int64())])
_PAIRS = pa.schema([("doc_id", pa.int64()), ("owner_id", pa.int64()), ("n_bytes", pa.int64())])


class Found:
    """What a terminal holds: the smallest identifier (none, id, file, row), how many rows had the text, and the addresses that it came from, four numbers (file, row, h, g) each."""

    __slots__ = ("least", "n", "addresses")

    def __init__(self, least: tuple, n: int, addresses):
        self.least, self.n, self.addresses = least, n, array("q", addresses)

    def take(self, other: Found) -> None:
        self.least = min(self.least, other.least)
        self.n += other.n
        self.addresses.extend(other.addresses)

    def copy(self) -> Found:
        return Found(self.least, self.n, self.addresses)


class _Node:
    """An edge key[start:end] and what is below it. found: of a terminal. spilled: number of the file that the subtree went to."""

    __slots__ = ("key", "start", "end", "below", "found", "spilled")

    def __init__(self, key: bytes, start: int, end: int):
        self.key, self.start, self.end = key, start, end
        self.below: dict[int, _Node] | None = None
        self.found: Found | None = None
        self.spilled: int | None = None


def common(a: bytes, b: bytes, start: int, end: int) -> int:
    """The first position from start at which a and b differ, at most end."""
    end = min(end, len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    x = np.frombuffer(a, np.uint8, end - start, start) != np.frombuffer(b, np.uint8, end - start, start)
    return start + int(x.argmax())


class PatriciaTrie:
    """Full byte strings with what was found. spill(number, [(key, found)]) takes what is over the bound of bytes; None keeps all."""

    def __init__(self, bound: int = TRIE_BYTES, spill: Callable | None = None):
        self.root = _Node(b"", 0, 0)
        self.bytes = self.files = 0
        self.inside: dict[int, list[int]] = {}  # numbers of subtrees spilled earlier, by the one that they are part of
        self.bound, self.spill = bound, spill

    def insert(self, key: bytes, found: Found) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                self.spill(node.spilled, [(key, found)])
                return
            if at == len(key):
                if node.found is None:
                    node.found = found.copy()
                else:
                    node.found.take(found)
                self.bytes += 8 * len(found.addresses)
                break
            if node.below is None:
                node.below = {}
            edge = node.below.get(key[at])
            if edge is None:
                edge = node.below[key[at]] = _Node(key, at, len(key))
                edge.found = found.copy()
                self.bytes += len(key) - at + 8 * len(found.addresses)
                break
            to = common(key, edge.key, at, edge.end)
            if to < edge.end:  # part the edge
                upper = _Node(edge.key, edge.start, to)
                upper.below = {edge.key[to]: edge}
                edge.start = to
                node.below[key[at]] = upper
                edge = upper
            node, at = edge, to
        if self.spill and self.bytes > self.bound:
            self._spill_largest()

    def entries(self, node: _Node | None = None) -> Iterator[tuple[bytes, Found]]:
        """Each text that is held, with what was found of it."""
        stack = [node or self.root]
        while stack:
            node = stack.pop()
            if node.found is not None:
                yield node.key[: node.end], node.found
            if node.below:
                stack.extend(node.below.values())

    def _spill_largest(self) -> None:
        """Empty the first subtree with at most half of what is held, going down by the largest, or the last one; a single text stays."""
        nodes, size = [self.root], {}
        for node in nodes:
            nodes.extend((node.below or {}).values())
        for node in reversed(nodes):
            size[node] = (node.end + 8 * len(node.found.addresses) if node.found is not None else 0) + sum(size[x] for x in (node.below or {}).values())
        best = self.root
        while best.below and (best is self.root or 2 * size[best] > size[self.root]):
            child = max(best.below.values(), key=size.get)
            if not size[child]:
                break
            best = child
        if not 0 < size[best] < size[self.root]:
            return
        number = self.files
        self.files += 1
        part = [best]
        for node in part:
            part.extend((node.below or {}).values())
        self.inside[number] = [node.spilled for node in part if node.spilled is not None]
        self.spill(number, list(self.entries(best)))
        best.below, best.found, best.spilled = None, None, number
        best.key = best.key[: best.end]
        self.bytes = size[self.root] - size[best]


class _Spills:
    """Files of spilled subtrees, in the shared folder; each call appends one file of a numbered subtree."""

    def __init__(self, base: str):
        self.fs, self.path = beside.filesystem(base)
        self.path = f"{self.path}/trie-{uuid.uuid4().hex}"
        self.pending: dict[int, list] = {}
        self.held: dict[int, int] = {}
        self.parts: dict[int, int] = {}

    def __call__(self, number: int, entries: list) -> None:
        self.pending.setdefault(number, []).extend(entries)
        self.held[number] = self.held.get(number, 0) + sum(len(k) for k, _ in entries)
        if self.held[number] > 4 << 20:
            self._flush(number)

    def _flush(self, number: int) -> None:
        rows = self.pending.pop(number, [])
        self.held[number] = 0
        if not rows:
            return
        none, ids, files, places = ([x.least[k] for _, x in rows] for k in range(4))
        flat = [x.addresses for _, x in rows]
        table = pa.table({"key": pa.array([k for k, _ in rows], pa.binary()), "none": none, "id": pa.array(ids, pa.int64()), "file": pa.array(files, pa.int64()), "row": pa.array(places, pa.int64()), "n": pa.array([x.n for _, x in rows], pa.int64()), "addresses": pa.array(flat, pa.list_(pa.int64()))})
        self.fs.create_dir(self.path, recursive=True)
        part = self.parts.get(number, 0)
        self.parts[number] = part + 1
        with self.fs.open_output_stream(f"{self.path}/{number}-{part}") as sink, pa.ipc.new_stream(sink, table.schema) as to:
            to.write_table(table, max_chunksize=1000)

    def subtree(self, number: int) -> Iterator[tuple[bytes, Found]]:
        self._flush(number)
        for part in range(self.parts.get(number, 0)):
            with self.fs.open_input_stream(f"{self.path}/{number}-{part}") as source:
                for b in pa.ipc.open_stream(source):
                    for key, none, i, file, row, n, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        yield key, Found((none, i, file, row), n, flat)

    def clear(self) -> None:
        if self.parts:
            self.fs.delete_dir(self.path)


def owners(entries: Iterator[tuple[bytes, Found]], base: str, bound: int) -> Iterator[tuple[bytes, Found]]:
    """Each distinct text with what was found of it, in memory bounded by `bound`, if no one text is longer."""
    spills = _Spills(base)
    trie = PatriciaTrie(bound, spills)
    for key, found in entries:
        trie.insert(key, found)
    yield from trie.entries()
    files, inside = trie.files, trie.inside
    del trie
    within = {x for some in inside.values() for x in some}

    def whole(number: int) -> Iterator[tuple[bytes, Found]]:
        todo = [number]
        for x in todo:
            yield from spills.subtree(x)
            todo.extend(inside[x])

    for number in range(files):
        if number not in within:
            part = list_bounded(whole(number), bound)
            yield from (merge_small(part) if isinstance(part, list) else owners(part, base, max(bound, 2 * max_key(whole(number)))))
    spills.clear()


def max_key(entries: Iterator[tuple[bytes, Found]]) -> int:
    return max((len(k) for k, _ in entries), default=0)


def list_bounded(entries: Iterator[tuple[bytes, Found]], bound: int):
    """The entries as a list if they fit, else an iterator over all of them."""
    held, size = [], 0
    for entry in entries:
        held.append(entry)
        size += len(entry[0])
        if size > bound:

            def again(first=held):
                yield from first
                yield from entries

            return again()
    return held


def merge_small(entries: list) -> Iterator[tuple[bytes, Found]]:
    trie = PatriciaTrie()
    for key, found in entries:
        trie.insert(key, found)
    yield from trie.entries()


def address(content: bytes) -> tuple[int, int]:
    """128 bits of hash as two signed numbers."""
    x = xxhash.xxh3_128_intdigest(content)
    return tuple(int(v) - (1 << 64) if v >> 63 else int(v) for v in (x >> 64, x & 0xFFFFFFFFFFFFFFFF))


def _contents(b: pa.RecordBatch) -> list[bytes]:
    return [x.as_py() for x in b.column("text")]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        keys = list(held)
        names = [address(k) for k in keys]
        least, n = [v[0] for v in held.values()], [v[1] for v in held.values()]
        rows = {"file": [last[0]] * len(keys), "row": [last[1] << beside.WINDOW] * len(keys), "n_bytes": [len(k) for k in keys], "h": [x for x, _ in names], "g": [x for _, x in names], "content": keys, "none": [x[0] for x in least], "id": [x[1] for x in least], "at_row": [x[2] for x in least], "n": n}
        held.clear()
        return batch(rows, _FOLDED)

    for file, window, b in beside.windows(batches):
        if held and (last != (file, window) or size > FOLD_BYTES):
            yield flush()
            size = 0
        last = (file, window)
        for doc_id, row, key in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), _contents(b), strict=True):
            least = (doc_id is None, doc_id or 0, row)
            if key in held:
                was = held[key]
                was[0], was[1] = min(was[0], least), was[1] + 1
            else:
                held[key] = [least, 1]
                size += len(key)
    if held:
        yield flush()


def _own(base: str, bound: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            for b in batches:
                for file, row, h, g, none, i, at, n, content in zip(*(b.column(c).to_pylist() for c in ("file", "row", "h", "g", "none", "id", "at_row", "n")), b.column("content"), strict=True):
                    yield content.as_py(), Found((none, i, file, at), n, (file, row, h, g))

        out: dict[str, list] = {n: [] for n in _OWNED.names}
        for _, found in owners(entries(), base, bound):
            if found.n > 1:
                none, i, at_file, at_row = found.least
                for k, name in enumerate(("file", "row", "h", "g")):
                    out[name] += found.addresses[k::4].tolist()
                m = len(found.addresses) // 4
                for name, value in (("owner_id", None if none else i), ("at_file", at_file), ("at_row", at_row)):
                    out[name] += [value] * m
                if len(out["h"]) > 50_000:
                    yield batch(out, _OWNED)
                    out = {n: [] for n in _OWNED.names}
        if out["h"]:
            yield batch(out, _OWNED)

    return run


def _copies(side: beside.Side) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for file, window, b in beside.windows(batches):
            if last != (file, window):
                last, got = (file, window), side.read(file, window)
                known = {} if got is None else {(h, g): rest for h, g, *rest in zip(*(got.column(c).to_pylist() for c in ("h", "g", "owner_id", "at_file", "at_row")), strict=True)}
            if not known:
                continue
            doc, own, size = [], [], []
            for doc_id, row, key in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), _contents(b), strict=True):
                found = known.get(address(key))
                if found and (found[1] != file or found[2] != row):
                    doc.append(doc_id)
                    own.append(found[0])
                    size.append(len(key))
            if doc:
                yield batch({"doc_id": doc, "owner_id": own, "n_bytes": size}, _PAIRS)

    return run


def exact_copies(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, owner_id, n_bytes) of every row whose text another row owns."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = beside.placed(docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("text", F.col("text").cast("binary"))
    parts = blocks.Layout(blocks.text_bytes(docs)).blocks
    folded = texts.mapInArrow(lean(_fold), FOLDED).repartition(parts, "n_bytes", "h", "g")
    side = beside.lay(folded.mapInArrow(lean(_own(shared_dir(spark), trie_bytes)), OWNED), "owners", parts)
    return texts.mapInArrow(lean(_copies(side)), "doc_id long, owner_id long, n_bytes long")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, owner_id, n_bytes
FROM (SELECT doc_id, strlen(text) AS n_bytes,
             min(doc_id) OVER (PARTITION BY text) AS owner_id,
             row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS nth
      FROM documents WHERE text IS NOT NULL)
WHERE nth > 1
"""
