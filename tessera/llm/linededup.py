"""Line deduplication with a filter for lines seen once and one for lines seen twice.

Hashes of lines go, packed, to the owner of their range. An owner has two Bloom
filters: a line whose bits are all in the first has been seen before, and is put
into the second; any other goes into the first. Lines that the second filter
holds are suspected repeats; their hashes return and are laid beside the windows
of documents that they came from, where a second scan meets them. Only suspected
lines are shuffled with their bytes: equal ones are counted exactly and the first
occurrence is chosen, by doc_id, then line number. A Bloom filter has no misses,
so no repeat is lost; false alarms end in the exact count. First occurrences go
back to the lines by 128 bits of hash of the line, those of very frequent lines
by a broadcast of fewer than HOT rows.

Lines are parted by newlines and compared byte by byte; those of white space
only are never repeats.

Defined results. One row for each line that isn't the first of its kind, with
the place of the first one. Documents with a null doc_id come after all others,
those with equal doc_id count as one sequence of rows ordered by their text's
hash; the lines of rows equal in both share their place, and each row names its own. Null and empty texts have
no lines. Lines may be very long. Other columns are passed over. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import beside, blocks
from tessera.llm.cluster import doc_key, joined_by_size, lean, small_batches, written
from tessera.llm.textcore import _BYTE, _P, mix, powers, string_buffer

#: Bits of a filter for each line, and hash functions.
FILTER_BITS, PROBES = 12, 3


def line_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes; first and end byte, text, and number within the text of each line that isn't blank."""
    raw, off = string_buffer(texts)
    breaks = np.flatnonzero(raw == 10)
    some = off[:-1] < off[1:]
    start = np.union1d(off[:-1][some], breaks + 1)
    start = start[start < len(raw)]
    owner = np.searchsorted(off, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(raw)), off[owner + 1]) if len(start) else start
    end = end - (raw[np.maximum(end - 1, 0)] == 10)
    number = np.arange(len(start)) - np.searchsorted(owner, owner)
    # white space only, by bytes; what lies beyond ASCII isn't blank
    solid = np.concatenate([[0], np.cumsum(raw > 32)])
    keep = solid[np.maximum(end, start)] > solid[start]
    return raw, start[keep], end[keep], owner[keep], number[keep]


def line_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(_P, len(raw)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_P, len(raw) + 1, True)[start] + (end - start).astype(np.uint64))


class Bloom:
    """A Bloom filter over 32-bit items."""

    def __init__(self, n: int):
        self.size = max(64, FILTER_BITS * n)
        self.bits = np.zeros(self.size, bool)

    def cells(self, items: np.ndarray) -> list[np.ndarray]:
        wide = mix(items.astype(np.uint64) + np.uint64(0x51ED270B))
        a, b = wide >> np.uint64(32), (wide & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return [((a + np.uint64(k) * b) % np.uint64(self.size)).astype(np.int64) for k in range(PROBES)]

    def has(self, items: np.ndarray) -> np.ndarray:
        found = np.ones(len(items), bool)
        for c in self.cells(items):
            found &= self.bits[c]
        return found

    def add(self, items: np.ndarray) -> None:
        for c in self.cells(items):
            self.bits[c] = True


def seen_twice(items: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Marks of the items that the filter of those seen twice holds in the end."""
    once, twice = Bloom(len(items)), Bloom(len(items) // 2)
    for a in range(0, len(items), step):
        part = items[a : a + step]
        kinds, count = np.unique(part, return_counts=True)
        twice.add(kinds[(count > 1) | once.has(kinds)])
        once.add(kinds)
    return twice.has(items).astype(np.uint8)


_SUSPECT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("line_no", pa.int64()), ("content", pa.binary())])


def _suspects(marks: blocks.Marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, window, b in beside.windows(batches, most=1 << 20, rows=2000):
            raw, start, end, owner, number = line_spans(b.column("text"))
            marks.go(file, window)
            at, _ = marks.find(marks.layout.ids(line_hashes(raw, start, end)))
            if len(at):
                text = raw.tobytes()
                mine = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(mine), b.column("key").take(mine), pa.array(number[at]), pa.array([text[x:y] for x, y in zip(start[at], end[at], strict=True)], pa.binary())],
                    schema=_SUSPECT,
                )

    return run


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no) of every line that has occurred before; lines count from 0."""
    small_batches(docs.sparkSession)
    keyed = beside.placed(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("key", doc_key())
    layout = blocks.Layout(blocks.text_bytes(docs), 4 * blocks.BLOCK_BYTES)

    def items(texts: pa.Array) -> np.ndarray:
        raw, start, end, _, _ = line_spans(texts)
        return layout.ids(line_hashes(raw, start, end))

    marks = blocks.recurring(keyed, items, layout, seen_twice, "lines")
    suspects = written(keyed.mapInArrow(lean(_suspects(marks)), "doc_id long, key long, line_no long, content binary"), "suspects")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line_no")
    named = [F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2")]
    first = suspects.groupBy("content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(*named, "first", "n")
    found = joined_by_size(suspects.select("doc_id", "key", "line_no", *named), first, ["h1", "h2"], "n", suspects.count())
    return found.where(place > F.col("first")).select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line
               FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
                     FROM documents WHERE text IS NOT NULL)),
solid AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x00-\x20]')),
placed AS (SELECT doc_id, line_no,
                  first_value(doc_id) OVER w AS first_doc_id, first_value(line_no) OVER w AS first_line_no,
                  row_number() OVER w AS nth
           FROM solid WINDOW w AS (PARTITION BY line ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, line_no, first_doc_id, first_line_no FROM placed WHERE nth > 1
"""
