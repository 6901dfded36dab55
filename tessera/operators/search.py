"""Full-text, vector and hybrid search over a table of documents."""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import MAYBE_COMPOUND, PARTS, WORD, lower_code_terms, lower_code_text
from tessera.functions.vector import cosine
from tessera.operators.ranking import global_rank, top
from tessera.session import spread, stored

K1, B = 1.2, 0.75
RRF_K = 60
WEIGHTS = {"code": 0.5, "text": 0.5}
SIMILARITY_CUT = 0.4
#: Rows of a page that may be broadcast.
BROADCAST_ROWS = 10_000
#: Postings that a worker lays together before it sends them, and segments of an index before they are merged.
STRETCH, SEGMENTS = 2_000_000, 8
#: ASCII letters in lower case, digits, all other bytes to spaces; MAYBE_COMPOUND for bytes.
LOWER = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))
COMPOUND = re.compile(MAYBE_COMPOUND.encode())
POSTING = ["term", "ids", "tfs", "lengths"]
KINDS = "class component constant function interface method method_def module namespace package property type_alias variable enum comment literal".split()
VISIBILITIES = "public protected private package all".split()


def query_terms(query: str, tokenizer=None) -> list[str]:
    """Distinct lower-case terms of a query, in order."""
    return list(dict.fromkeys(t for word in re.findall(WORD, query) for t in _word_terms(word)))


def _joined_terms(tokenizer, text: Column) -> Column:
    """Terms in lower case with single spaces between, of any tokenizer whose tokens hold no space."""
    return lower_code_text(text) if tokenizer is lower_code_terms else F.trim(F.lower(F.array_join(tokenizer(text), " ")))


def _n_terms(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("double")


def _times(spaced: Column, term: str) -> Column:
    """How often a term is among those of `spaced`, which has spaces of its own around each."""
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(f" {term} "), F.lit("")))) / F.lit(len(term.encode()) + 2)).cast("double")


def term_weight(tf: Column, length: Column, df: float, n: float, mean: float) -> Column:
    """What a term adds to the BM25 score of a document of this length."""
    idf = math.log10((n - df + 0.5) / (df + 0.5) + 1.0)
    return F.lit(idf) * (tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean))))


def bm25_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", score: str = "bm25", tokenizer=lower_code_terms) -> DataFrame:
    """(id, score) of every document with a query term.

    One scan tokenizes every text, once, without a shuffle: it counts the query's
    terms, stores the documents that have any, as narrow rows, and observes the
    corpus statistics on the way. A `TextIndex` answers without reading texts.
    """
    terms = query_terms(query)
    tokens = _joined_terms(tokenizer, F.col(text_col))
    names = [f"_tf{i}" for i in range(len(terms))]
    spaced = F.concat(F.lit(" "), F.replace(tokens, F.lit(" "), F.lit("  ")), F.lit(" "))
    counts = [_times(spaced, term).alias(name) for name, term in zip(names, terms, strict=True)]
    seen = Observation()
    rows = spread(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)).select(F.col(id_col), _n_terms(tokens).alias("_len"), *counts)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"), *[F.count_if(F.col(name) > 0).alias(name) for name in names])
    found = stored(rows.where(F.greatest(*[F.col(name) for name in names], F.lit(0.0), F.lit(0.0)) > 0), "hits")
    stats = seen.get
    total = F.lit(0.0)
    for name in names:
        if stats[name]:
            total = total + F.when(F.col(name) > 0, term_weight(F.col(name), F.col("_len"), float(stats[name]), float(stats["n"]), stats["mean"])).otherwise(F.lit(0.0))
    return found.select(id_col, F.round(total, 8).alias(score))


def _word_terms(word: str) -> list[str]:
    """The word and, if it is a compound, its parts, in lower case."""
    parts = re.sub(PARTS, " ", word).split(" ")
    return [w.lower() for w in ([word, *parts] if len(parts) > 1 else [word])]


def _inverted(batches: Iterator[pa.RecordBatch], joined: bool = False) -> Iterator[pa.RecordBatch]:
    """(id, text) to (term, ids, tfs, lengths): lists for stretches of documents, those of the empty term hold every document. Terms are those of lower_code_terms, or what single spaces part if the text is joined."""
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    parts: dict[bytes, list[bytes]] = {}
    at, tfs, lengths, counts, ids = array("i"), array("i"), array("i"), array("i"), []

    def lists() -> pa.RecordBatch:
        words = sorted(codes)
        place = np.empty(len(words), np.int32)
        place[[codes[w] for w in words]] = np.arange(len(words), dtype=np.int32)
        term = place[np.frombuffer(at, np.int32)]
        order = np.argsort(term, kind="stable")
        row = np.repeat(np.arange(len(counts)), np.frombuffer(counts, np.int32))[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))]).astype(np.int32)
        values = pa.concat_arrays(ids).take(pa.array(row)), pa.array(np.frombuffer(tfs, np.int32)[order]), pa.array(np.frombuffer(lengths, np.int32)[row])
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), *(pa.ListArray.from_arrays(ends, v) for v in values)], POSTING)

    for batch in batches:
        begun = 0
        for n, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            found = Counter(filter(None, text.split(b" ")) if joined else text.translate(LOWER).split())
            for word in () if joined else COMPOUND.findall(text):
                if (more := parts.get(word)) is None:
                    more = parts[word] = [t.encode() for t in _word_terms(word.decode())[1:]]
                for part in more:
                    found[part] += 1
            lengths.append(found.total())
            found[b""] = 0
            at.extend(map(codes.__getitem__, found))
            tfs.extend(found.values())
            counts.append(len(found))
            if len(at) >= STRETCH:
                ids.append(batch.column(0).slice(begun, n + 1 - begun))
                yield lists()
                begun = n + 1
                codes.clear(), parts.clear(), ids.clear()
                at, tfs, lengths, counts = array("i"), array("i"), array("i"), array("i")
        ids.append(batch.column(0).slice(begun))
    if len(at):
        yield lists()


class TextIndex:
    """An inverted index in a folder, of segments. A segment holds postings (term, ids, tfs, lengths), lists for stretches of documents sorted by term, so that a search reads the row groups of its terms and no text; those of the empty term hold all its documents. Beside them are the ids `gone`, which earlier segments have no more.

    A refresh writes a segment of what changed, and merges them all when there
    are more than SEGMENTS; then it names them in `current`, so readers see one
    version or the other.
    """

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "doc_id", tokenizer=lower_code_terms):
        self.spark, self.folder, self.id_col, self.tokenizer = spark, folder.rstrip("/"), id_col, tokenizer

    def _current(self) -> list[str] | None:
        try:
            rows = self.spark.read.text(f"{self.folder}/current").collect()
        except AnalysisException:
            return None
        return max((r.value for r in rows)).split(" ") if rows else None

    def built(self) -> bool:
        return self._current() is not None

    def _postings(self, docs: DataFrame, text_col: str) -> DataFrame:
        kind = docs.schema[self.id_col].dataType.simpleString()
        rows, joined = spread(docs.where(F.col(text_col).isNotNull()).select(self.id_col, text_col)), self.tokenizer is not lower_code_terms
        if joined:
            rows = rows.select(self.id_col, _joined_terms(self.tokenizer, F.col(text_col)))
        return rows.mapInArrow(partial(_inverted, joined=joined), f"term string, ids array<{kind}>, tfs array<int>, lengths array<int>")

    def _write(self, before: list[str], postings: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        segment = f"v{uuid.uuid4().hex}"
        narrow = stored(postings, "postings")  # else texts would be read once more for the ranges' ends
        narrow.repartitionByRange("term", F.col("ids")[0]).sortWithinPartitions("term").write.parquet(f"{self.folder}/{segment}/postings")
        if gone is not None:
            gone.write.parquet(f"{self.folder}/{segment}/gone")
        self.spark.createDataFrame([(" ".join([*before, segment]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/current")
        return self

    def _entries(self, segments: list[str], terms: list[str] | None) -> DataFrame:
        """(term, id, tf, length) of these terms, or of all, for the documents that there are."""
        parts = []
        for k, segment in enumerate(segments):
            lists = self.spark.read.parquet(f"{self.folder}/{segment}/postings")
            lists = lists if terms is None else lists.where(F.col("term").isin(terms))
            rows = lists.select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).toDF("term", self.id_col, "tf", "length")
            if later := [f"{self.folder}/{x}/gone" for x in segments[k + 1 :]]:
                rows = rows.join(self.spark.read.parquet(*later), self.id_col, "left_anti").select("term", self.id_col, "tf", "length")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _merged(self, segments: list[str]) -> DataFrame:
        rows = stored(self._entries(segments, None), "entries")
        stretch = F.pmod(F.xxhash64(self.id_col), F.lit(1 + rows.where("term = ''").count() // STRETCH))
        entries = rows.groupBy("term", stretch.alias("_stretch")).agg(F.collect_list(F.struct(F.col(self.id_col).alias("ids"), "tf", "length")).alias("e"))
        return entries.select("term", F.col("e.ids").alias("ids"), F.col("e.tf").alias("tfs"), F.col("e.length").alias("lengths"))

    def build(self, docs: DataFrame, text_col: str = "text") -> TextIndex:
        """Index all of docs; what was there before is superseded."""
        return self._write([], self._postings(docs, text_col))

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, text_col: str = "text") -> TextIndex:
        """Replace the entries of the documents in changed, and drop those of the ids in removed."""
        if (segments := self._current()) is None:
            return self.build(changed, text_col)
        gone = changed.select(self.id_col) if removed is None else changed.select(self.id_col).union(removed.select(self.id_col))
        self._write(segments, self._postings(changed, text_col), gone)
        if len(segments := self._current()) > SEGMENTS:
            self._write([], self._merged(segments))
        return self

    def scores(self, query: str, score: str = "bm25") -> DataFrame:
        """(id, score) of every document with a term of the query, as bm25_scores gives them."""
        if (segments := self._current()) is None:
            raise ValueError("the index has not been built")
        terms = query_terms(query)
        n, mean = self._entries(segments, [""]).agg(F.count("*"), F.avg("length")).first()
        hits = stored(self._entries(segments, terms), "hits")
        df = {r.term: float(r.n) for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each term of the query
        total = F.lit(0.0)
        for term in terms:
            if term in df:
                weight = term_weight(F.col("tf").cast("double"), F.col("length").cast("double"), df[term], float(n), mean)
                total = total + F.coalesce(F.sum(F.when(F.col("term") == term, weight)), F.lit(0.0))
        return hits.groupBy(self.id_col).agg(F.round(total, 8).alias(score))


def cosine_scores(vectors: DataFrame, query: list[float] | Column, id_col: str = "vec_id", vector_col: str = "embedding", score: str = "similarity", cut: float = SIMILARITY_CUT) -> DataFrame:
    """(id, score) of every vector at least as similar as the cut."""
    against = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector_col).isNotNull()).select(id_col, F.round(cosine(F.col(vector_col), against), 8).alias(score)).where(F.col(score) >= cut)


def fused(ranked: dict[str, DataFrame], id_col: str, weights: dict[str, float] = WEIGHTS, k: int = RRF_K, score: str = "rrf") -> DataFrame:
    """Weighted reciprocal-rank fusion of rank lists (id, rank)."""
    parts = [df.select(id_col, (F.lit(float(weights[name])) / (F.lit(float(k)) + F.col("rank"))).alias("_part")) for name, df in ranked.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(id_col).agg(F.sum("_part").alias(score))


@dataclass(frozen=True)
class SearchRequest:
    """What to search for; ranks are taken over the whole table, filters apply after."""

    text: str | None = None
    vector: list[float] | None = None
    name: str | None = None
    kind: str | None = None
    visibility: str | None = None
    sources: tuple[str, ...] = ()
    boost_source: str | None = None
    boost_factor: float = 1.1
    limit: int = 20
    offset: int = 0
    similarity_cut: float = SIMILARITY_CUT
    kind_boosts: dict[str, float] = field(default_factory=dict)

    def checked(self) -> SearchRequest:
        """Itself, or a ValueError that lists what is possible."""
        if self.kind is not None and self.kind.lower() not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; one of {', '.join(KINDS)}")
        if self.visibility is not None and self.visibility.lower() not in VISIBILITIES:
            raise ValueError(f"unknown visibility {self.visibility!r}; one of {', '.join(VISIBILITIES)}")
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset can't be negative")
        return self


def conditions(request: SearchRequest, columns: list[str]) -> Column:
    """Filters of a request, over the columns that there are; those not given don't filter."""
    found = F.lit(True)
    if request.name and "name" in columns:
        found &= F.lower("name") == request.name.lower()
    if request.kind and "kind" in columns:
        found &= F.col("kind") == request.kind.lower()
    if request.visibility and request.visibility.lower() != "all" and "visibility" in columns:
        found &= F.col("visibility") == request.visibility.lower()
    if request.sources and "source" in columns:
        found &= F.col("source").isin(list(request.sources))
    return found


def search(docs: DataFrame, request: SearchRequest, id_col: str = "doc_id", text_col: str = "text", vectors: DataFrame | None = None, vector_id: str = "vec_id", vector_col: str = "embedding", factor: int = 2, index: TextIndex | None = None) -> DataFrame:
    """The page of hits, `factor` times the limit for post-processing, with column rrf; by name if neither text nor vector is given."""
    request = request.checked()
    lists = {}
    if request.vector is not None and vectors is not None:
        near = cosine_scores(vectors, request.vector, vector_id, vector_col, cut=request.similarity_cut).withColumnRenamed(vector_id, id_col)
        lists["code"] = global_rank(near, "similarity", id_col, "rank")
    if request.text:
        scores = index.scores(request.text) if index else bm25_scores(docs, request.text, id_col, text_col)
        lists["text"] = global_rank(scores, "bm25", id_col, "rank")
    keep = conditions(request, docs.columns)
    if not lists:
        order = [F.col("name").asc_nulls_last()] if "name" in docs.columns else []
        return top(docs.where(keep), factor * request.limit, *order, F.col(id_col).asc(), offset=request.offset)
    boost = F.lit(1.0)
    for kind, by in request.kind_boosts.items():
        boost = F.when(F.col("kind") == kind, F.lit(float(by))).otherwise(boost)
    if "search_boost" in docs.columns:
        boost = boost * F.coalesce(F.col("search_boost").cast("double"), F.lit(1.0))
    if request.boost_source and request.boost_factor != 1:
        boost = boost * F.when(F.col("source") == request.boost_source, F.lit(float(request.boost_factor))).otherwise(F.lit(1.0))
    narrow = docs.where(keep).select(id_col, *[c for c in ("name", "kind", "source", "search_boost") if c in docs.columns])
    scored = narrow.join(fused(lists, id_col), id_col).withColumn("rrf", F.round(F.col("rrf") * boost, 10)).select(id_col, "rrf")
    page = top(scored, factor * request.limit, F.col("rrf").desc(), F.col(id_col).asc(), offset=request.offset)
    small = factor * request.limit <= BROADCAST_ROWS
    return docs.join(F.broadcast(page) if small else page, id_col)  # wide rows only for the page
