"""Benchmark decontamination by rare seeds and local alignment.

A first pass counts, over all documents, how often each word of the test items
occurs. Runs of `n` words of an item are seeds if chance alone would rarely
bring their words together, as the counts say; an item keeps its rarest quarter
in any case. A second pass joins the passages of each document to the items
whose seeds they hold, sets a window around seeds that lie on nearby diagonals,
and scores it against the item by Smith-Waterman alignment of words, with which
copies that are edited, cut or rephrased in places still score high.

Rarity is judged from single words, not from how often the seed was seen, so an
item that leaked into very many documents keeps its seeds. Test items travel to
the tasks in parts of bounded size; a larger set of items takes more passes and
no larger broadcast.

Defined results. A row for each document and item with the best window's score,
if at or above the threshold; repeated rows of documents give a row each, items
that are repeated under other numbers are all named. Null or empty texts hold
nothing, items that are null or have fewer than n words match nothing. Ties
between windows go to the first. Whole texts are read, however long. Other
columns are passed over. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cluster import lean, small_batches
from tessera.llm.textcore import Lookup, Words, chunks

N = 3
#: How many times per document a seed may be met by chance.
CHANCE = 1e-3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of the item's score against itself.
LEAST = 0.4
#: Words of test items that one pass carries.
PART_WORDS = 2_000_000


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Occurrences of each word (sorted hashes) over all of docs, all words, and documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(shared.value)
        total = np.zeros(size, np.int64)
        for b in chunks(batches):
            words = Words(b.column("text"))
            total[:-2] += np.bincount(table.find(words.hash)[1], minlength=size - 2)
            total[-2:] += len(words), b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(size, np.int64)
    for at, n in docs.select("text").mapInArrow(lean(run), "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out[:-2], int(out[-2]), int(out[-1])


class Items:
    """Test items: words, and the seeds that lead to them."""

    def __init__(self, ids: list, texts: pa.Array, n: int = N):
        self.ids, self.n = ids, n
        words = Words(texts)
        self.hash, self.doc = words.hash, words.doc
        self.length = words.counts()
        self.grams, self.gram_item, self.gram_at = words.grams(n)
        self.vocabulary = np.unique(words.hash)

    def choose(self, counts: np.ndarray, words: int, documents: int, chance: float) -> None:
        """Keep the rare seeds, given the corpus counts of the vocabulary."""
        p = np.log(np.maximum(counts, 0.5) / max(1, words))[np.searchsorted(self.vocabulary, self.hash)]
        rarity = sum(p[self.gram_at + k] for k in range(self.n)) + np.log(max(1.0, words / max(1, documents)))
        order = np.lexsort((rarity, self.gram_item))
        first = np.searchsorted(self.gram_item[order], self.gram_item[order])
        n = np.bincount(self.gram_item, minlength=len(self.ids))[self.gram_item[order]]
        keep = np.zeros(len(order), bool)
        keep[order] = np.arange(len(order)) - first < np.ceil(n / 4)
        keep |= rarity <= np.log(chance)
        at = np.flatnonzero(keep)
        at = at[np.argsort(self.grams[at], kind="stable")]
        self.seeds, self.start = np.unique(self.grams[at], return_index=True)
        self.start = np.append(self.start, len(at))
        self.seed_item, self.seed_at = self.gram_item[at], (self.gram_at - self.doc[self.gram_item])[at]
        del self.grams, self.gram_item, self.gram_at


def align(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment scores of rows of items against rows of windows (word hashes; 0 pads items, 1 pads windows)."""
    m, width = windows.shape
    slope = (GAP * np.arange(width)).astype(np.int32)
    above = np.zeros((m, width + 1), np.int32)
    best = np.zeros(m, np.int32)
    for i in range(items.shape[1]):
        here = np.where(windows == items[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH))
        here += above[:, :-1]
        np.maximum(here, above[:, 1:] + GAP, out=here)
        np.maximum(here, 0, out=here)
        here -= slope
        np.maximum.accumulate(here, axis=1, out=here)
        here += slope
        np.maximum(here, 0, out=here)
        np.maximum(best, here.max(1), out=best)
        above[:, 1:] = here
    return best


def windows_of(words: Words, items: Items, table: Lookup) -> np.ndarray:
    """Rows (text, item, first word, end word), positions in the chunk, around seeds on nearby diagonals."""
    grams, owner, where = words.grams(items.n)
    at, seed = table.find(grams)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    n = items.start[seed + 1] - items.start[seed]
    take = np.repeat(items.start[seed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    at = np.repeat(at, n)
    item, doc = items.seed_item[take], owner[at]
    diagonal = where[at] - items.seed_at[take]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    length = items.length[item]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > length[1:] // 2 + 3)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(doc)) - 1
    slack = length[start] // 4 + 3
    first = np.maximum(diagonal[start] - slack, words.doc[doc[start]])
    last = np.minimum(diagonal[end] + length[start] + slack, words.doc[doc[start] + 1])
    return np.stack([doc[start], item[start], first, last], 1)


def scored(words: Words, items: Items, found: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """Alignment scores of windows."""
    out = np.zeros(len(found), np.int64)
    wide = found[:, 3] - found[:, 2]
    order = np.lexsort((wide, items.length[found[:, 1]]))
    at = 0
    while at < len(order):
        to = at + 1
        most = wide[order[at]]
        while to < len(order) and (to - at) * max(most, wide[order[to]]) < cells // 16 and items.length[found[order[to], 1]] <= 1.25 * items.length[found[order[at], 1]] + 2:
            most = max(most, wide[order[to]])
            to += 1
        part = order[at:to]
        rows = found[part]
        length = items.length[rows[:, 1]]
        col = np.arange(int(length.max()))
        a = np.where(col < length[:, None], items.hash[np.minimum(items.doc[rows[:, 1]][:, None] + col, len(items.hash) - 1)], np.uint64(0))
        col = np.arange(int(most))
        b = np.where(col < wide[part][:, None], words.hash[np.minimum(rows[:, 2][:, None] + col, len(words.hash) - 1)], np.uint64(1))
        out[part] = align(a, b)
        at = to
    return out


def _finder(shared, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        table = Lookup(items.seeds)
        for b in chunks(batches, rows=2000):
            words = Words(b.column("text"))
            found = windows_of(words, items, table)
            score = scored(words, items, found)
            share = score / (MATCH * items.length[found[:, 1]])
            good = np.flatnonzero(share >= least)
            good = good[np.lexsort((found[good, 2], -share[good], found[good, 1], found[good, 0]))]
            pair = found[good, 0] * len(items.ids) + found[good, 1]
            good = good[np.diff(pair, prepend=-1) != 0]
            doc, item = found[good, 0], found[good, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(share[good]), pa.array(found[good, 2] - words.doc[doc]), pa.array(found[good, 3] - found[good, 2])],
                ["doc_id", "item_id", "score", "start_word", "n_words"],
            )

    return run


def item_parts(benchmark: DataFrame, n: int, words: int = PART_WORDS) -> Iterator[Items]:
    """The test items, in parts of about so many words at most."""
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    size = F.octet_length("text").cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // (5 * words)))
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if got.num_rows:
            yield Items(got.column("item_id").to_pylist(), got.column("text").combine_chunks(), n)


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, chance: float = CHANCE, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, start_word, n_words) of every document that holds a test item."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
    found = None
    for items in item_parts(benchmark, n):
        items.choose(*word_counts(docs, items.vocabulary), chance)
        part = docs.select("doc_id", "text").mapInArrow(lean(_finder(spark.sparkContext.broadcast(items), least)), schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = N, chance: float = CHANCE, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all columns, that hold no test item."""
    spark = docs.sparkSession
    small_batches(spark)
    for items in item_parts(benchmark, n):
        items.choose(*word_counts(docs, items.vocabulary), chance)
        docs = docs.mapInArrow(lean(_keeper(spark.sparkContext.broadcast(items), least)), docs.schema)
    return docs


def _keeper(shared, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        table = Lookup(items.seeds)
        for b in chunks(batches, rows=2000):
            words = Words(b.column("text"))
            found = windows_of(words, items, table)
            bad = np.zeros(b.num_rows, bool)
            bad[found[scored(words, items, found) >= least * MATCH * items.length[found[:, 1]], 0]] = True
            yield b.filter(pa.array(~bad))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
