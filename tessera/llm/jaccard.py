"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each document and a column for each distinct run of
`n` words. It is cut into column blocks by the n-gram's hash. A first pass over
the blocks finds each column's degree, and a document whose shared n-grams are
fewer than the threshold's share of its size is discarded: no partner can reach
the bound. What is left is ordered by degree, rarest first, and two documents
that can reach the threshold then meet in the first few of their n-grams.
Documents with the same n-grams are one row of the matrix. Rows that meet by
chance alone would chain a large corpus into one block. So rows that are much
alike find each other first, by a few keys, and other pairs that meet are
discarded unless their parities (a bit for each cell, whether an odd number of
n-grams falls into it) leave room for the overlap that their sizes ask for; that
test has no misses. What is left, directly or by others, forms a row block;
there the product is taken exactly, frequent columns by dense matrix products
and the others by adding up pairs, and pairs whose overlap is below the bound
that follows from their sizes are discarded. A row block with very many rows is cut into tiles by size, and tiles
too different in size are never multiplied. The n-grams of a row travel once for
each product that it takes part in.

The result has a row for each document with a link: its class, by the smallest
doc_id that links lead to, and the sums of its links. No link is lost; links are
counted, never listed, so the result grows as the documents do.

N-grams are told apart by 35 to 64 bits of hash, at least as many as keep false
twins in a block below one in a thousand items; a false twin could only change
an overlap by one.

Defined results. Every row of docs is a document of its own, so repeated rows are
copies of each other. A null doc_id is named as null and comes after all others.
Texts with fewer than n words have one n-gram, all their words; null texts and
those without words have none and no partner. Words are compared in lower case.
Other columns are passed over. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import beside, blocks
from tessera.llm.cluster import doc_key, free_name, joined_by_size, lean, small_batches, written
from tessera.llm.graph import components, forest
from tessera.llm.textcore import Words, mix, span_hashes

N = 3
#: Least Jaccard similarity, as a fraction.
THRESHOLD = (11, 20)
#: Rows of a row block that are multiplied at once; a larger one is tiled.
TILE = 1024
#: Columns with at most so many documents add up pairs; the others are dense.
SPARSE = 10
#: Keys by which rows that are much alike find each other first.
BANDS, WIDE = 12, 4
#: Pairs of rows that share an n-gram but no such key are looked at one by one if an n-gram has at most so many; else they go into one row block unseen.
CROSS = 1 << 15


def gram_items(n: int) -> Callable:
    """The n-grams of each text; all its words if they are fewer than n."""

    def items(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        hashes, owner, _ = words.grams(n)
        count = words.counts()
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            whole = span_hashes(words.hash, words.doc[few], words.doc[few + 1])
            hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, few])
        return owner, hashes

    return items


def _degrees(items: np.ndarray) -> np.ndarray:
    """For each item 0 if it is the only one of its kind, else a class that grows with the number of its kind."""
    both = (items.astype(np.uint64) << np.uint64(32)) | np.arange(len(items), dtype=np.uint64)
    both.sort()
    kind = (both >> np.uint64(32)).astype(np.uint32)
    start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(kind)))
    level = np.minimum(255, (8 * np.log2(np.maximum(1, count))).astype(np.int64)).astype(np.uint8)
    out = np.empty(len(items), np.uint8)
    out[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.repeat(level, count)
    return out


ABLE = "file long, row long, doc_id long, key long, kind long, size long, prefix long, has boolean, grams binary"
_ABLE = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("kind", pa.int64()), ("size", pa.int64()), ("prefix", pa.int64()), ("has", pa.bool_()), ("grams", pa.binary())])


def _survivors(marks: blocks.Marks, n: int, p: int, q: int) -> Callable:
    """Documents that can have a partner; `kind` is the same for those with the same n-grams, and the first that a task sees of a kind has them, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        items = gram_items(n)
        for file, window, b in beside.windows(batches):
            marks.go(file, window)
            owner, ids = marks.layout.distinct(*items(b.column("text")))
            sizes = np.bincount(owner, minlength=b.num_rows)
            at, level = marks.find(ids)
            doc = owner[at]
            shared = np.bincount(doc, minlength=b.num_rows)
            able = (shared > 0) & (shared * q >= p * sizes)
            keep = able[doc]
            doc, ids, level = doc[keep], ids[at][keep], level[keep]
            order = np.lexsort((ids, level, doc))
            ids = ids[order]
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(mix(ids + np.uint64(1)), out=sums[1:])
            some = np.flatnonzero(able)
            if not len(some):
                continue
            row = b.column("row").to_numpy()
            alone = mix(row.astype(np.uint64) ^ mix(np.full(1, file, np.int64).view(np.uint64)))
            kind = np.where(shared == sizes, mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64)), alone).view(np.int64)
            prefix = sizes - -(-p * sizes // q) + 1 - (sizes - shared)
            has = np.zeros(len(some), bool)
            for i, x in enumerate(kind[some].tolist()):
                has[i] = x not in seen
                seen.add(x)
            grams = [ids[ends[i] : ends[i + 1]].tobytes() if h else None for i, h in zip(some.tolist(), has.tolist(), strict=True)]
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("file", "row", "doc_id", "key")), *(pa.array(x[some]) for x in (kind, sizes, prefix)), pa.array(has), pa.array(grams, pa.binary())], schema=_ABLE
            )

    return run


def size_step(size: np.ndarray, p: int, q: int) -> np.ndarray:
    """Sizes by steps such that only those of one step or of neighbouring ones can reach the threshold."""
    return np.floor(np.log(size) / np.log(q / p * 1.0001)).astype(np.int64)


def _once(gram: list[np.ndarray], kind: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(gram, a, b): each key of a task once, with one of its kinds (b null), and edges that connect the kinds that share one here."""
    if not gram:
        return
    gram, kind = np.concatenate(gram).view(np.int64), np.concatenate(kind)
    order = np.argsort(gram, kind="stable")
    gram, kind = gram[order], kind[order]
    met = gram[1:] == gram[:-1]
    a, b = forest(kind[1:][met], kind[:-1][met])
    new = np.concatenate([[True], ~met])
    gram, kind = gram[new], kind[new]
    for at in range(0, len(gram), 100_000):
        s = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(gram[s]), pa.array(kind[s]), pa.nulls(len(gram[s]), pa.int64())], ["gram", "a", "b"])
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(a), pa.array(b)], ["gram", "a", "b"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BANDS keys of each kind, from the smallest hashes of its n-grams, WIDE at a time, and its size; kinds that are much alike share one."""
    keys, kinds = [], []
    for b in batches:
        if not b.num_rows:
            continue
        step = np.floor(4 * np.log2(b.column("size").to_numpy())).astype(np.uint64)
        parts = [np.frombuffer(g, np.uint64) for g in b.column("grams").to_pylist()]
        start = np.cumsum([0] + [len(x) for x in parts[:-1]])
        ids = np.concatenate(parts)
        for band in range(BANDS):
            key = step + np.uint64(band << 8)
            for k in range(WIDE):
                key = mix(key ^ np.minimum.reduceat(mix(ids ^ np.uint64(0x9E3779B97F4A7C15 * (WIDE * band + k + 1) % 2**64)), start))
            keys.append(key)
            kinds.append(b.column("kind").to_numpy())
    yield from _once(keys, kinds)


def size_step(size: np.ndarray, p: int, q: int) -> np.ndarray:
    """Sizes by steps such that only those of one step or of neighbouring ones can reach the threshold."""
    return np.floor(np.log(size) / np.log(q / p * 1.0001)).astype(np.int64)


def _postings(side: beside.Side, p: int, q: int) -> Callable:
    """(gram, kind, label) of the first n-grams of each kind. An n-gram counts as another one for each size step, so that kinds too different in size don't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for file, window, b in beside.windows(batches, rows=4096, most=4 << 20, column="grams"):
            if at != (file, window):
                at, got = (file, window), side.read(file, window)
                rows, labels = (None, None) if got is None else (got.column(c).to_numpy() for c in ("row", "label"))
            if rows is None:
                continue
            place = b.column("row").to_numpy()
            found = np.minimum(np.searchsorted(rows, place), len(rows) - 1)
            mine = np.flatnonzero(rows[found] == place)  # kinds that were chosen here
            step = size_step(b.column("size").to_numpy(), p, q).astype(np.uint64)
            salt = [mix(step + np.uint64(1 + k)) for k in (0, 1)]
            grams, prefix, kind = b.column("grams"), b.column("prefix").to_numpy(), b.column("kind").to_numpy()
            first = [np.frombuffer(grams[i].as_py(), np.uint64)[: prefix[i]] for i in mine.tolist()]
            if not first:
                continue
            n = [len(x) for x in first]
            key, who = np.concatenate(first), np.repeat(mine, n)
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(mix(key ^ salt[k][who]).view(np.int64)), pa.array(kind[who]), pa.array(labels[found[who]])], ["gram", "kind", "label"])

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sure): kinds of different labels that share an n-gram. Where they would be more than CROSS pairs, edges that connect them all, sure."""
    held = [tuple(b.column(c).to_numpy() for c in range(3)) for b in batches if b.num_rows]
    if not held:
        return
    gram, kind, label = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.lexsort((kind, label, gram))
    gram, kind, label = gram[order], kind[order], label[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    end = np.append(start[1:], len(gram))
    mixed = label[start] != label[end - 1]
    two = mixed & (end - start == 2)
    a, b, sure = [kind[start[two]]], [kind[start[two] + 1]], []
    for x, y in zip(start[mixed & ~two].tolist(), end[mixed & ~two].tolist(), strict=True):
        cut = np.flatnonzero(np.diff(label[x:y])) + 1
        m = np.diff(np.concatenate([[0], cut, [y - x]]))
        if ((y - x) ** 2 - int((m * m).sum())) // 2 > CROSS:
            sure.append((kind[x + 1 : y], kind[x : y - 1]))
            continue
        group = np.repeat(np.arange(len(m)), m)
        i, j = np.nonzero(group[:, None] < group[None, :])
        a.append(kind[x + i])
        b.append(kind[x + j])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.zeros(int(new.sum()), bool))], ["a", "b", "sure"])
    if sure:
        a, b = forest(np.concatenate([x for x, _ in sure]), np.concatenate([y for _, y in sure]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a), bool))], ["a", "b", "sure"])


def parities(ids: np.ndarray) -> int:
    """A bit for each of at least twice as many cells as there are ids: whether an odd number of them falls into it."""
    bits = max(6, (2 * len(ids) - 1).bit_length())
    odd = np.bincount((mix(ids) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return int.from_bytes(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes(), "little")


def apart(x: int, n: int, y: int, m: int) -> int:
    """At least by so many do a set of n ids with parities x and one of m with y differ."""
    i, j = (max(6, (2 * k - 1).bit_length()) for k in (n, m))
    if i < j:
        x, y, i, j = y, x, j, i
    while i > j:  # cells of the larger one, two by two
        i -= 1
        raw = np.unpackbits(np.frombuffer(x.to_bytes(1 << max(0, i - 2), "little"), np.uint8), bitorder="little")
        x = int.from_bytes(np.packbits(raw[::2] ^ raw[1::2], bitorder="little").tobytes(), "little")
    return (x ^ y).bit_count()


SIGNED = "kind long, size long, shared long, cells binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [np.frombuffer(g, np.uint64) for g in b.column("grams").to_pylist()]
        cells = [(x := parities(g)).to_bytes(-(-x.bit_length() // 8), "little") for g in parts]
        yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("size"), pa.array([len(g) for g in parts], pa.int64()), pa.array(cells, pa.binary())], ["kind", "size", "shared", "cells"])


def _possible(p: int, q: int) -> Callable:
    """The pairs whose parities leave room for the overlap that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("a_size", "b_size", "a_shared", "b_shared", "a_cells", "b_cells")), strict=True)
            ok = [apart(int.from_bytes(c, "little"), n, int.from_bytes(d, "little"), m) <= n + m - 2 * -(-p * (x + y) // (p + q)) for x, y, n, m, c, d in rows]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the kinds that share n-grams here, or are connected by an edge already."""
    held = [tuple(b.column(c) for c in range(3)) for b in batches if b.num_rows]
    if held:
        gram, a = (np.concatenate([x[k].to_numpy() for x in held]) for k in (0, 1))
        b = np.concatenate([x[2].fill_null(0).to_numpy() for x in held])
        edge = ~np.concatenate([x[2].is_null().to_numpy(zero_copy_only=False) for x in held])
        gram, node = gram[~edge], a[~edge]
        order = np.argsort(gram, kind="stable")
        gram, node = gram[order], node[order]
        met = gram[1:] == gram[:-1]
        a, b = forest(np.concatenate([node[1:][met], a[edge]]), np.concatenate([node[:-1][met], b[edge]]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def overlaps(ids: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
    """The m x m counts of common items; ids are distinct within a document."""
    total = np.zeros((m, m), np.int32)
    order = np.argsort(ids, kind="stable")
    ids, doc = ids[order], doc[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(ids)))
    codes, held = [], 0
    for length in range(2, SPARSE + 1):
        at = start[count == length]
        for i in range(length):
            for j in range(i + 1, length):
                if len(at):
                    codes.append(doc[at + i] * m + doc[at + j])
                    held += len(at)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(codes), minlength=m * m).reshape(m, m).astype(np.int32)
                    codes, held = [], 0
    if codes:
        total += np.bincount(np.concatenate(codes), minlength=m * m).reshape(m, m).astype(np.int32)
    dense = np.flatnonzero(count > SPARSE)
    for a in range(0, len(dense), 2048):
        some = dense[a : a + 2048]
        cells = np.concatenate([np.arange(start[c], start[c] + count[c]) for c in some])
        block = np.zeros((m, len(some)), np.float32)
        block[doc[cells], np.repeat(np.arange(len(some)), count[some])] = 1
        total += np.triu(block @ block.T, 1).astype(np.int32)
    return np.triu(total, 1) + np.tril(total, -1).T


def multiply(sizes: np.ndarray, grams: list[bytes], p: int, q: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of different rows at or above p/q, and their overlap; with left, only pairs of one of the first `left` and one of the others."""
    parts = [np.frombuffer(g, np.uint64) for g in grams]
    found = overlaps(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]), len(parts))
    ok = found.astype(np.int64) * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    if left is not None:
        ok[left:] = False
        ok[:, :left] = False
    i, j = np.nonzero(np.triu(ok, 1))
    return i, j, found[i, j].astype(np.int64)


def _beside_grams(side: beside.Side) -> Callable:
    """The n-grams of chosen rows, once for each product that they take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, got = None, None, None
        for file, window, b in beside.windows(batches, rows=4096, most=4 << 20, column="grams"):
            if at != (file, window):
                at, got = (file, window), side.read(file, window)
                rows = None if got is None else got.column("row").to_numpy()
            if got is None:
                continue
            place = b.column("row").to_numpy()
            first, last = np.searchsorted(rows, place), np.searchsorted(rows, place, "right")
            n = last - first
            mine = np.repeat(np.arange(len(place)), n)
            take = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(mine))
            for a in range(0, len(mine), 1024):
                s = slice(a, a + 1024)
                its, own = got.take(pa.array(take[s])).combine_chunks(), b.take(pa.array(mine[s]))
                yield pa.RecordBatch.from_arrays([*(its.column(c).combine_chunks().cast(t) for c, t in (("group", pa.int64()), ("side", pa.int32()))), own.column("kind"), its.column("n").combine_chunks(), own.column("size"), own.column("grams")], ["group", "side", "kind", "n", "size", "grams"])

    return run


PRODUCT = "kind long, other long, links long, overlap long, best double"
_PRODUCT = pa.schema([("kind", pa.int64()), ("other", pa.int64()), ("links", pa.int64()), ("overlap", pa.int64()), ("best", pa.float64())])


def _products(p: int, q: int) -> Callable:
    """For each row the sums of its links in a product (other null), and edges (kind, other) that connect the rows which links connect.

    Input is sorted by group, and within it by side; a group with sides 0 and 1 is a product of two tiles, side 2 a tile times itself, and none a whole row block.
    """

    def emit(rows: list[tuple], left: int | None) -> Iterator[pa.RecordBatch]:
        kind, n, sizes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        i, j, overlap = multiply(sizes, [r[3] for r in rows], p, q, left)
        if not len(i):
            return
        m = len(rows)
        share = overlap / (sizes[i] + sizes[j] - overlap)
        links, sums, best = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
        for x, y in ((i, j), (j, i)):
            np.add.at(links, x, n[y])
            np.add.at(sums, x, n[y] * overlap)
            np.maximum.at(best, x, share)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(kind[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some]), pa.array(sums[some]), pa.array(best[some])], schema=_PRODUCT)
        a, b = forest(kind[i], kind[j])
        none = np.zeros(len(a), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(none), pa.array(none), pa.array(none.astype(np.float64))], schema=_PRODUCT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole small groups, multiplied together
        rows: list[tuple] = []
        group, items = None, 0

        def close():
            nonlocal held, rows, items
            if rows and rows[0][-1] == 2:  # one tile by itself; with another of its component its pairs would come twice
                yield from emit(rows, None)
            elif rows and rows[0][-1] is not None:  # two tiles
                yield from emit(rows, sum(r[-1] == 0 for r in rows))
            else:
                held += rows
                items += sum(len(r[3]) // 8 for r in rows)
                if len(held) >= TILE // 2 or items > 1 << 20:
                    yield from emit(held, None)
                    held, items = [], 0
            rows = []

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("group", "kind", "n", "size", "grams", "side")), strict=True):
                if r[0] != group:
                    yield from close()
                    group = r[0]
                rows.append(r[1:])
        yield from close()
        if held:
            yield from emit(held, None)

    return run


def _tiled(rows: DataFrame, p: int, q: int) -> DataFrame:
    """Rows of large row blocks with the groups of the products that they take part in.

    Sizes fall into steps by the threshold, so that only rows of one step or of
    neighbouring ones can be similar; a step is cut into tiles by hash. A pair of
    tiles is a group, and so is a tile with itself.
    """
    step = F.floor(F.ln(F.col("size").cast("double")) / F.lit(float(np.log(q / p * 1.0001)))).cast("int")
    rows = rows.withColumn("step", step)
    counts = written(rows.groupBy("component", "step").agg(F.count("*").alias("many")).withColumn("tiles", F.ceil(F.col("many") / F.lit(TILE // 2)).cast("int")), "steps")
    near = lambda by, name: counts.select("component", (F.col("step") + by).alias("step"), F.col("tiles").alias(name))
    around = counts.join(near(-1, "above"), ["component", "step"], "left").join(near(1, "below"), ["component", "step"], "left")
    own = joined_by_size(rows, around, ["component", "step"], "many", rows.count()).withColumn("tile", F.pmod(F.xxhash64("kind"), F.col("tiles")).cast("int"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda step, tile, other_step, other: F.xxhash64("component", step, tile, other_step, other).alias("group")
    s, t = F.col("step"), F.col("tile")
    same = F.transform(upto(F.col("tiles")), lambda x: F.struct(name(s, F.least(t, x), s, F.greatest(t, x)), F.when(x == t, 2).when(t < x, 0).otherwise(1).alias("side")))
    above = F.transform(upto(F.col("above")), lambda x: F.struct(name(s, t, s + 1, x), F.lit(0).alias("side")))
    below = F.transform(upto(F.col("below")), lambda x: F.struct(name(s - 1, x, s, t), F.lit(1).alias("side")))
    return own.select("*", F.explode(F.concat(same, above, below)).alias("g")).select("file", "row", "n", "g.group", "g.side")


def _row_blocks(held: DataFrame, kinds: DataFrame, named: DataFrame, parts: int, p: int, q: int) -> DataFrame:
    """(key, component) of the kinds that can be linked to another one."""
    alike = written(components(held.select("kind", "size", "grams").mapInArrow(lean(_bands), "gram long, a long, b long").repartition(parts, "gram").mapInArrow(lean(_meetings), "a long, b long")), "alike")
    label = F.coalesce("component", "kind").alias("label")
    side = beside.lay(kinds.join(alike.withColumnRenamed("key", "kind"), "kind", "left").select(F.col("at.at_file").alias("file"), F.col("at.at_row").alias("row"), label), "labels", parts)
    met = named.mapInArrow(lean(_postings(side, p, q)), "gram long, kind long, label long").repartition(parts, "gram")
    met = written(met.mapInArrow(lean(_across), "a long, b long, sure boolean"), "met")
    cells = written(held.select("kind", "size", "grams").mapInArrow(lean(_signatures), SIGNED), "cells").dropDuplicates(["kind"])
    of = lambda end: cells.select(F.col("kind").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("size", "shared", "cells")))
    near = met.where("NOT sure").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(_possible(p, q)), "a long, b long")
    return components(near.unionByName(met.where("sure").select("a", "b")).unionByName(alike.where("key <> component").select(F.col("key").alias("a"), F.col("component").alias("b"))))


def linked(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Documents that can have a partner, of docs with doc_id, text, file and row: (file, row, doc_id, key, kind). And their kinds with at least one link: n, links, overlap, best, and the first document of the class."""
    small_batches(docs.sparkSession)
    p, q = threshold
    base = docs.withColumn("key", doc_key())
    layout = blocks.Layout(blocks.text_bytes(docs))
    grams = gram_items(n)
    marks = blocks.recurring(base, lambda texts: layout.distinct(*grams(texts))[1], layout, _degrees, "degrees")
    able = written(base.select("file", "row", "doc_id", "key", "text").mapInArrow(lean(_survivors(marks, n, p, q)), ABLE), "able")
    held = able.where("has")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "file", "row")
    stored = beside.placed(able, "at_file", "at_row")
    kinds = stored.groupBy("kind").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min(place).alias("first"), F.min(F.when(F.col("has"), F.struct("at_file", "at_row"))).alias("at"))
    kinds = written(kinds, "kinds")
    named = stored.where("has").select(F.col("at_file").alias("file"), F.col("at_row").alias("row"), "kind", "size", "prefix", "grams")
    label = _row_blocks(held, kinds, named, layout.blocks, p, q)
    rows = written(kinds.join(label.withColumnRenamed("key", "kind"), "kind").select("kind", "component", "n", "size", F.col("at.at_file").alias("file"), F.col("at.at_row").alias("row")), "rows")
    big = written(rows.groupBy("component").agg(F.count("*").alias("many")), "sizes")
    sized = joined_by_size(rows, big, ["component"], "many", rows.count())
    parts = sized.where(F.col("many") <= TILE).select("file", "row", "n", F.col("component").alias("group"), F.lit(None).cast("int").alias("side"))
    if big.where(F.col("many") > TILE).take(1):
        parts = parts.unionByName(_tiled(sized.where(F.col("many") > TILE).drop("many"), p, q))
    side = beside.lay(parts, "groups", layout.blocks)
    placed = named.mapInArrow(lean(_beside_grams(side)), "group long, side int, kind long, n long, size long, grams binary").repartition(layout.blocks, "group").sortWithinPartitions("group", "side", "kind")
    found = written(placed.mapInArrow(lean(_products(p, q)), PRODUCT), "products")
    sums = found.where("other IS NULL").groupBy("kind").agg(F.sum("links").alias("links"), F.sum("overlap").alias("overlap"), F.max("best").alias("best"))
    label = components(found.where("other IS NOT NULL").select(F.col("kind").alias("a"), F.col("other").alias("b"))).withColumnRenamed("key", "kind")
    zero = lambda c: F.coalesce(c, F.lit(0))
    copies = F.col("n") - 1
    whole = kinds.join(sums, "kind", "left").join(label, "kind", "left").where("n > 1 OR links > 0")
    whole = whole.select("kind", "n", "first", (copies + zero("links")).alias("links"), (copies * F.col("size") + zero("overlap")).alias("overlap"), F.greatest(F.when(copies > 0, F.lit(1.0)), "best").alias("best"), F.coalesce("component", "kind").alias("component"))
    whole = written(whole, "linked")
    firsts = whole.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("many"))
    return able.select("file", "row", "doc_id", "key", "kind"), written(joined_by_size(whole.drop("first"), firsts, ["component"], "many", whole.count()), "classes")


def _of_documents(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    return joined_by_size(rows, kinds, ["kind"], "n", rows.count())


def near_copies(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, sum_overlap, best_jaccard) of every document with a link.

    A link is another document at or above the threshold; n_links counts them,
    sum_overlap adds up the n-grams shared with each, and best_jaccard is the
    highest similarity. class_id is the smallest doc_id that links lead to.
    """
    found = _of_documents(*linked(beside.placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), n, threshold))
    return found.select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("links").alias("n_links"), F.col("overlap").alias("sum_overlap"), F.col("best").alias("best_jaccard"))


def _absent(side: beside.Side, file: str, row: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone = None, np.zeros(0, np.int64)
        for f, window, b in beside.windows(batches, file=file, row=row):
            if at != (f, window):
                at, got = (f, window), side.read(f, window)
                gone = np.zeros(0, np.int64) if got is None else got.column("row").to_numpy()
            yield b.filter(pa.array(~np.isin(b.column(row).to_numpy(), gone))).drop_columns([file, row])

    return run


def keep_one(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of docs without those that links connect to a document with a smaller doc_id (nulls last, then by the text's hash, then by place)."""
    file, row = free_name(docs, "in_file"), free_name(docs, "in_row")
    stored = beside.placed(docs, file, row)
    rows, kinds = linked(stored.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(file).alias("file"), F.col(row).alias("row")), n, threshold)
    gone = _of_documents(rows, kinds).where((F.col("head.file") != F.col("file")) | (F.col("head.row") != F.col("row"))).select("file", "row")
    side = beside.lay(gone, "gone", blocks.Layout(blocks.text_bytes(docs)).blocks)
    return stored.mapInArrow(lean(_absent(side, file, row)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(n: int = N, threshold: tuple[int, int] = THRESHOLD) -> str:
    p, q = threshold
    last = n - 1
    return rf"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, w
           FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL)
           WHERE len(w) > 0),
grams AS (SELECT DISTINCT k, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ')
                 ELSE array_to_string(w[i:i + {last}], ' ') END AS g
          FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {last}, 1) + 1)) AS i FROM numbered)),
sizes AS (SELECT k, count(*) AS size FROM grams GROUP BY k),
counted AS (SELECT a.k AS ka, b.k AS kb, count(*) AS overlap FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
links AS (SELECT ka, kb, overlap, overlap::DOUBLE / (x.size + y.size - overlap) AS jaccard
          FROM counted JOIN sizes x ON x.k = ka JOIN sizes y ON y.k = kb
          WHERE overlap * {p + q} >= {p} * (x.size + y.size)),
reach(a, b) AS (SELECT ka, kb FROM links UNION SELECT a, kb FROM reach JOIN links ON ka = b)
SELECT n.doc_id, c.class_id, l.n_links, l.sum_overlap, l.best_jaccard
FROM (SELECT ka AS k, count(*) AS n_links, sum(overlap)::BIGINT AS sum_overlap, max(jaccard) AS best_jaccard FROM links GROUP BY ka) l
JOIN (SELECT a AS k, min(doc_id) AS class_id FROM reach JOIN numbered ON k = b GROUP BY a) c USING (k)
JOIN numbered n USING (k)
"""


ORACLE = oracle()
