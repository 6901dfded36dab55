"""Substring deduplication: word windows that repeat, with a count-min prefilter.

Every window of `size` words has an anchor, the smallest hash of the runs of
`size // 2 + 1` words in it, so equal windows have equal anchors. Tasks send
their anchors, packed, to the owners of hash ranges; an owner merges them into a
count-min sketch of its range, and anchors whose estimated count is below two
are done with. A sketch never underestimates, so no repeated window is lost. The
other anchors are laid beside the documents, and a second pass over these groups
exactly the windows under them, by 64 bits of a second hash within an anchor's
block: each stretch of documents sends a window once, with its first place, so a
passage in very many documents is no large group. What an owner finds, the first
place of each window that repeats, is laid beside the documents in turn, and a
last pass makes spans of it. Texts are never shuffled.

The result names maximal spans: words covered by consecutive windows that all
are the first of their kind (is_first) or all have their first occurrence in
the same document (first_doc_id).

Defined results. Spans are counted in words from 0. First is the smallest
doc_id, nulls last, then the text's hash, then the place. Rows equal in doc_id
and text are one document, and each of them gives its spans. Null texts and texts
with fewer than `size` words have no windows. Words are compared in lower case,
what separates them isn't compared. Windows that repeat within one document count
as repeats; texts of any length are read whole. Other columns are passed over. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import beside, blocks
from tessera.llm.cluster import doc_key, lean, small_batches
from tessera.llm.textcore import _Q2, Lookup, Words, mix, run_starts, span_hashes

SIZE = 50
#: Cells of a sketch row for each anchor, and rows.
WIDTH, DEPTH = 4, 2


def sliding(x: np.ndarray, n: int, of) -> np.ndarray:
    """of(x[i:i+n]) for each i, for of = np.minimum or np.maximum; by doubling."""
    have, span = x, 1
    while span * 2 <= n:
        have = of(have[:-span], have[span:])
        span *= 2
    return of(have[: len(have) - (n - span)], have[n - span :]) if n > span else have


class Windows:
    """Windows of a chunk: `at` their first words in the chunk, `owner` their text, `anchor` their anchor's hash; and the anchors of each text."""

    def __init__(self, texts: pa.Array, size: int):
        self.words = Words(texts)
        self.size = size
        doc, gram = self.words.doc, size // 2 + 1
        self.at = run_starts(doc, size)
        self.owner = np.searchsorted(doc, self.at, "right") - 1
        if not len(self.at):
            self.anchor = self.picked = np.zeros(0, np.uint64)
            return
        total = int(doc[-1])
        fits = np.arange(total - gram + 1)
        x = span_hashes(self.words.hash, fits, fits + gram)
        least = sliding(x, size - gram + 1, np.minimum)
        self.anchor = least[self.at]
        # an anchor is a run that is the least of some window
        valid = np.zeros(len(x) + size - gram, np.uint64)
        valid[size - gram :][self.at] = self.anchor
        most = sliding(valid, size - gram + 1, np.maximum)[: len(x)]
        place = np.flatnonzero((most == x) & (most > 0))
        self.picked = mix(x[place])
        self.anchor = mix(self.anchor)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run with one anchor in one text."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        start = np.flatnonzero(new)
        return start, np.diff(np.append(start, len(self.at)))


def estimated_repeats(items: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Marks of items that a count-min sketch, merged from parts, estimates at two or more."""
    width = max(64, WIDTH * len(items))
    wide = [(mix(items.astype(np.uint64) + np.uint64(k * 0x9E3779B1)) % np.uint64(width)).astype(np.int64) for k in range(DEPTH)]
    out = np.ones(len(items), bool)
    for cells in wide:
        row = np.zeros(width, np.uint32)
        for a in range(0, len(cells), step):
            where, n = np.unique(cells[a : a + step], return_counts=True)
            row[where] += n.astype(np.uint32)
        out &= row[cells] > 1
    return out.astype(np.uint8)


def _steps(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as planes of the bytes of their differences, modulo 2**32."""
    d = np.diff(x.astype(np.uint32), prepend=np.uint32(0))
    return d.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_steps(data: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
    return np.cumsum(d, dtype=np.uint32).astype(np.int64)


class Documents:
    """A numbered list of documents by (doc_id, key), doc_id perhaps null, and their order."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, keys: np.ndarray):
        self.ids, self.none, self.keys = ids, none, keys

    def __len__(self) -> int:
        return len(self.ids)

    def ranks(self) -> np.ndarray:
        """Places in the order by doc_id, nulls last, then key; equal for equal ones."""
        order = np.lexsort((self.keys, self.ids, self.none))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.keys[order]) != 0) | (np.diff(self.ids[order]) != 0) | (self.none[order][1:] != self.none[order][:-1])
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def some(self, which: np.ndarray) -> dict[str, bytes]:
        return {"ids": self.ids[which].tobytes(), "none": self.none[which].tobytes(), "keys": self.keys[which].tobytes()}

    @staticmethod
    def joined(rows: list[dict]) -> Documents:
        ids, none, keys = (np.frombuffer(b"".join(r[n] for r in rows), kind) for n, kind in (("ids", np.int64), ("none", bool), ("keys", np.int64)))
        return Documents(ids, none, keys)


#: hashes of windows; number in the row's list of documents and first word of each; whether a window recurs in another place of those sent with it; the documents
PLACES = "file long, row long, block int, hashes binary, docs binary, starts binary, again binary, ids binary, none binary, keys binary"
_BYTES = ("hashes", "docs", "starts", "again", "ids", "none", "keys")
_PLACES = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("block", pa.int32()), *((n, pa.binary()) for n in _BYTES)])


def _under(marks: blocks.Marks, texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word within it, block and hash of each window under a marked anchor, by place."""
    w = Windows(texts, size)
    start, length = w.runs()
    hit, _ = marks.find(marks.layout.ids(w.anchor[start]))
    start, length = start[hit], length[hit]
    which = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    at, owner = w.at[which], w.owner[which]
    block = w.anchor[which] >> np.uint64(64 - marks.layout.bits)
    return owner, at - w.words.doc[owner], block.astype(np.int64), span_hashes(w.words.hash, at, at + size, _Q2)


def firsts_of(hashes: np.ndarray, place: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the index of its kind's first one by place, and whether the kind has more than one place."""
    order = np.lexsort((place, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)]
    apart = (place[order] != place[head][group]) | again[order]
    more = np.bincount(group[apart], minlength=len(head)) > 0
    first, repeated = np.empty(len(order), np.int64), np.empty(len(order), bool)
    first[order], repeated[order] = head[group], more[group]
    return first, repeated


def _sent(file: int, window: int, held: list[tuple], docs: Documents) -> pa.RecordBatch:
    """The windows of a stretch of documents, each once with its first place."""
    doc, start, block, hashes = (np.concatenate([h[k] for h in held]) for k in range(4))
    place = (docs.ranks()[doc] << 32) | start
    first, repeated = firsts_of(hashes, place, np.zeros(len(hashes), bool))
    own = np.flatnonzero(first == np.arange(len(first)))
    own = own[np.lexsort((place[own], block[own]))]
    cut = np.flatnonzero(np.diff(block[own], prepend=-1))
    rows = []
    for part in np.split(own, cut[1:]) if len(own) else []:
        used, number = np.unique(doc[part], return_inverse=True)
        rows.append({"file": file, "row": window << beside.WINDOW, "block": int(block[part[0]]), "hashes": hashes[part].tobytes(), "docs": _steps(number), "starts": _steps(start[part]), "again": np.packbits(repeated[part]).tobytes(), **docs.some(used)})
    return pa.RecordBatch.from_pylist(rows, schema=_PLACES)


def _candidates(marks: blocks.Marks, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs: list[tuple] = []
        many = n = 0
        last = None

        def flush() -> pa.RecordBatch:
            nonlocal many, n
            out = _sent(*last, held, Documents(*(np.concatenate([d[k] for d in docs]) for k in range(3))))
            held.clear()
            docs.clear()
            many = n = 0
            return out

        for file, window, b in beside.windows(batches, most=1 << 20, rows=2000):
            if held and (last != (file, window) or many > blocks.BATCH_ITEMS):
                yield flush()
            last = (file, window)
            marks.go(file, window)
            owner, start, block, hashes = _under(marks, b.column("text"), size)
            if len(owner):
                ids = b.column("doc_id")
                held.append((owner + n, start, block, hashes))
                docs.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column("key").to_numpy()))
                many, n = many + len(owner), n + b.num_rows
        if held:
            yield flush()

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups the windows of a block; of those that repeat, each stretch of documents gets the first place."""
    rows: dict[int, list[dict]] = {}
    for b in batches:
        for r in b.to_pylist():
            rows.setdefault(r["block"], []).append(r)
    for block in list(rows):  # one, as blocks are partitions
        mine = rows.pop(block)
        docs = Documents.joined(mine)
        offset = np.cumsum([0] + [len(r["ids"]) // 8 for r in mine])
        count = [len(r["hashes"]) // 8 for r in mine]
        hashes = np.frombuffer(b"".join(r["hashes"] for r in mine), np.uint64)
        doc = np.concatenate([_from_steps(r["docs"]) + o for r, o in zip(mine, offset, strict=False)])
        start = np.concatenate([_from_steps(r["starts"]) for r in mine])
        again = np.concatenate([np.unpackbits(np.frombuffer(r["again"], np.uint8), count=n) for r, n in zip(mine, count, strict=True)]).astype(bool)
        first, repeated = firsts_of(hashes, (docs.ranks()[doc] << 32) | start, again)
        a = 0
        for r, n in zip(mine, count, strict=True):
            hit = np.flatnonzero(repeated[a : a + n]) + a
            a += n
            if len(hit):
                used, number = np.unique(doc[first[hit]], return_inverse=True)
                out = {"file": r["file"], "row": r["row"], "block": block, "hashes": hashes[hit].tobytes(), "docs": _steps(number), "starts": _steps(start[first[hit]]), "again": b"", **docs.some(used)}
                yield pa.RecordBatch.from_pylist([out], schema=_PLACES)


_SPANS = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64()), ("is_first", pa.bool_())])


def _spans(marks: blocks.Marks, side: beside.Side, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for file, window, b in beside.windows(batches, most=1 << 20, rows=2000):
            marks.go(file, window)
            if last != (file, window):
                last, got = (file, window), side.read(file, window)
                rows = [] if got is None else got.to_pylist()
                del got
                firsts = Documents.joined(rows)
                offset = np.cumsum([0] + [len(r["ids"]) // 8 for r in rows])
                known = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
                first = np.concatenate([np.zeros(0, np.int64), *(_from_steps(r["docs"]) + o for r, o in zip(rows, offset, strict=False))])
                begin = np.concatenate([np.zeros(0, np.int64), *(_from_steps(r["starts"]) for r in rows)])
                rows.clear()
                order = np.argsort(known, kind="stable")
                table, first, begin = Lookup(known[order]), first[order], begin[order]
            if not len(table.values):
                continue
            owner, start, _, hashes = _under(marks, b.column("text"), size)
            at, which = table.find(hashes)
            if not len(at):
                continue
            owner, start, doc, begun = owner[at], start[at], first[which], begin[which]
            head = (firsts.keys[doc] == b.column("key").to_numpy()[owner]) & (begun == start)
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(owner) != 0) | (np.diff(start) != 1) | (firsts.ids[doc][1:] != firsts.ids[doc][:-1]) | (firsts.none[doc][1:] != firsts.none[doc][:-1]) | (head[1:] != head[:-1])
            a = np.flatnonzero(new)
            n = np.diff(np.append(a, len(at)))
            o, f = owner[a], doc[a]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(o)), pa.array(start[a]), pa.array(n + size - 1), pa.array(firsts.ids[f], mask=firsts.none[f]), pa.array(head[a])], schema=_SPANS)

    return run


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, is_first) of all spans of repeated windows."""
    small_batches(docs.sparkSession)
    keyed = beside.placed(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("key", doc_key())
    layout = blocks.Layout(blocks.text_bytes(docs))
    marks = blocks.recurring(keyed, lambda texts: layout.ids(Windows(texts, size).picked), layout, estimated_repeats, "anchors")
    sent = keyed.mapInArrow(lean(_candidates(marks, size)), PLACES).repartitionById(layout.blocks, F.col("block"))
    firsts = beside.lay(sent.mapInArrow(lean(_exact), PLACES), "firsts", layout.blocks)
    return keyed.mapInArrow(lean(_spans(marks, firsts, size)), "doc_id long, start_word long, n_words long, first_doc_id long, is_first boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(size: int = SIZE) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
windows AS (SELECT doc_id, i - 1 AS start, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM d WHERE len(w) >= {size})),
kinds AS (SELECT doc_id, start, first_value(doc_id) OVER w AS first_doc_id, row_number() OVER w = 1 AS is_first, count(*) OVER (PARTITION BY h) AS n
          FROM windows WINDOW w AS (PARTITION BY h ORDER BY doc_id, start)),
islands AS (SELECT *, start - row_number() OVER (PARTITION BY doc_id, first_doc_id, is_first ORDER BY start) AS island FROM kinds WHERE n > 1)
SELECT doc_id, min(start) AS start_word, (count(*) + {size - 1})::BIGINT AS n_words, first_doc_id, is_first
FROM islands GROUP BY doc_id, first_doc_id, is_first, island
"""


ORACLE = oracle()
