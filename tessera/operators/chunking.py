"""Chunks of text by paragraph, sentence, phrase and word."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, LEAST = 512, 64
#: Separators from coarse to fine; each stays with what precedes it.
LEVELS = [re.compile(p) for p in (r"\n\s*\n", r"(?<=[.!?])\s+", r"\s*[,;:()]\s*", r"\s+")]


def count_words(text: str) -> int:
    return len(text.split())


def pieces(pattern: re.Pattern, text: str, a: int, z: int) -> Iterator[tuple[int, int]]:
    """Spans of text[a:z] that end with a separator each, but for the last."""
    at = a
    for m in pattern.finditer(text[a:z]):
        yield at, a + m.end()
        at = a + m.end()
    if at < z:
        yield at, z


def packed(text: str, spans: list[tuple[int, int]], most: int, least: int | None, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """Neighbours joined up to `most` tokens; one with `least` tokens or more stays alone."""
    out: list[tuple[int, int]] = []
    open_at, held = None, 0
    for a, z in spans:
        n = count(text[a:z])
        alone = least is not None and n >= least
        if open_at is not None and (alone or held + n > most):
            out.append((open_at, a))
            open_at, held = None, 0
        if alone:
            out.append((a, z))
        elif open_at is None:
            open_at, held = a, n
        else:
            held += n
    if open_at is not None:
        out.append((open_at, spans[-1][1]))
    return out


def chunk_spans(text: str, most: int = MOST, least: int | None = None, count: Callable[[str], int] = count_words) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `most` tokens that tile the text; a single longer word is a chunk."""
    if least is not None and least > most:
        raise ValueError("least can't be above most")

    def split(a: int, z: int, level: int) -> list[tuple[int, int]]:
        if level == len(LEVELS) or count(text[a:z]) <= most:
            return [(a, z)]
        leaves: list[tuple[int, int]] = []
        for s, e in pieces(LEVELS[level], text, a, z):
            leaves += split(s, e, level + 1) if count(text[s:e]) > most else [(s, e)]
        return packed(text, leaves, most, least, count) if len(leaves) > 1 else leaves

    return split(0, len(text), 0)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, least: int | None = LEAST, beside: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns beside it, chunk_no, start, end, chunk) of every text; null and empty texts have none. Identifiers may be null or repeated."""
    names = [id_col, *beside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, n, a, z, t[a:z]) for row, t in enumerate(batch.column(text_col).to_pylist()) for n, (a, z) in enumerate(chunk_spans(t, most, least)) if z > a]
            at, *columns = zip(*found, strict=True) if found else [()] * 5
            rows = pa.array(at, pa.int64())
            parts = [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names), *parts], [*names, "chunk_no", "start", "end", "chunk"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.where(F.col(text_col).isNotNull()).select(*names, text_col).mapInArrow(run, f"{kinds}, chunk_no int, start int, end int, chunk string")


def token_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 128, overlap: int = 64) -> DataFrame:
    """(id, window_no, start, n, body): overlapping windows of words, the last one ending with the text."""
    step = size - overlap
    tokens = F.filter(F.split(F.col(text_col), r"\s+"), lambda t: t != "")
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, tokens.alias("_t")).where(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_t") - F.lit(overlap) - F.lit(1), F.lit(0)), F.lit(step))
    out = rows.select(id_col, "_t", F.posexplode(starts).alias("window_no", "start"))
    body = F.slice("_t", F.col("start") + 1, size)
    return out.select(id_col, "window_no", "start", F.size(body).alias("n"), F.array_join(body, " ").alias("body"))


def mean_pooled(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, at, mean): the mean vector of each group, a row for each position; it isn't scaled to unit length."""
    return vectors.select(group, F.posexplode(vector).alias("at", "v")).groupBy(group, "at").agg(F.avg(F.col("v").cast("double")).alias("mean"))
