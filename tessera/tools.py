"""The engine's queries as tools: a name, a schema of arguments, and a call that gives text."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.components import CodeGraph, SymbolIndex
from tessera.functions import render
from tessera.lang import language_of
from tessera.operators import graph, paths, search, summary
from tessera.operators.embed import EmbeddingProvider, query_vector
from tessera.operators.tables import Catalog
from tessera.sources.repo import with_content

TOOLS: dict[str, Tool] = {}


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    arguments: dict
    call: Callable

    def schema(self) -> dict:
        """The tool as a function that language models may call."""
        return {"name": self.name, "description": self.about, "parameters": {"type": "object", "properties": self.arguments}}


def tool(name: str, about: str, **arguments: dict) -> Callable:
    def register(call: Callable) -> Callable:
        TOOLS[name] = Tool(name, about, arguments, call)
        return call

    return register


class Project:
    """A catalog with the tree that it was made from."""

    def __init__(self, spark: SparkSession, catalog: Catalog, root: str, repo: str = "main", provider: EmbeddingProvider | None = None, count_tokens: Callable[[str], int] = lambda text: len(text.split())):
        self.spark, self.catalog, self.root, self.repo = spark, catalog, root, repo
        self.provider, self.count_tokens = provider, count_tokens

    def run(self, name: str, arguments: dict | str | None = None, as_json: bool = False) -> str:
        """Call a tool with a dict or JSON text; ValueError for unknown tools and arguments."""
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name!r}; one of {', '.join(sorted(TOOLS))}")
        given = json.loads(arguments) if isinstance(arguments, str) else dict(arguments or {})
        if unknown := set(given) - set(TOOLS[name].arguments):
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
        result = TOOLS[name].call(self, **given)
        return result if isinstance(result, str) else render.as_json(result) if as_json else render.as_text(result)

    def content(self, path: str) -> bytes | None:
        rows = self._contents([path]).take(1)
        return None if not rows or rows[0].content is None else bytes(rows[0].content)

    def _contents(self, names: list[str]) -> DataFrame:
        """(path, content) of known files."""
        known = self.catalog.read("files").where(F.col("path").isin(names)).select("path", F.lit(0).cast("long").alias("size"))
        return with_content(known, self.root).select("path", "content")

    def summaries(self, names: list[str], mode: str) -> dict[str, str]:
        contents = self._contents(names) if names and mode == "source" else None
        found = summary.file_summaries(self.catalog.read("files"), self.catalog.read("nodes"), names, summary.Mode(mode), contents)
        return {r.path: r.summary for r in found.collect()}


    def hit_texts(self, hits: list[Row], mode: summary.Mode) -> list[str | None]:
        """What is shown of each hit: nothing, its source, or its definition within its ancestors and with its members."""
        if mode is summary.Mode.SKIP or not hits:
            return [None] * len(hits)
        if mode is summary.Mode.SOURCE:
            return [r.body for r in hits]
        some = self.catalog.read("nodes").where(F.col("path").isin(sorted({r.path for r in hits})))  # of the files of one page
        by: dict[tuple, list[dict]] = {}
        for r in some.collect():
            by.setdefault((r.repo, r.path), []).append(r.asDict(recursive=True))
        return [summary.hit_text(r.id, by[r.repo, r.path], language_of(r.path), mode is summary.Mode.DOCUMENTATION) for r in hits]


_TEXT, _MANY, _NUMBER, _FLAG = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer"}, {"type": "boolean"}


@tool("list_files", "Paths that match any of the patterns.", patterns=_MANY)
def list_files(p: Project, patterns: list[str] = ()) -> list[str]:
    return [r.path for r in paths.matching(p.catalog.read("files"), list(patterns)).select("path").orderBy("path").collect()]


@tool("complete_path", "Paths that hold the characters in order, best first.", needle=_TEXT, limit=_NUMBER)
def complete_path(p: Project, needle: str = "", limit: int = 5) -> list[str]:
    return [r.path for r in paths.filename_complete(p.catalog.read("files"), needle, "path", limit).collect()]


@tool("read_file", "A file as it is.", path=_TEXT)
def read_file(p: Project, path: str = "") -> str:
    return render.response_text(render.file_response(path, p.content))


@tool("summarize_files", "Definitions in files.", paths=_MANY, summary_mode=_TEXT)
def summarize_files(p: Project, paths: list[str] = (), summary_mode: str = "definition") -> list[dict]:
    if summary_mode == "source":
        raise ValueError("source mode is for reading files")
    found = p.summaries(list(paths), summary_mode)
    return [{"path": n, "summary": found[n]} for n in paths if n in found]


@tool("search_symbols", "Symbols by text, name, kind and visibility; of all repositories if global_search is set.", query=_TEXT, symbol_name=_TEXT, kind=_TEXT, visibility=_TEXT, limit=_NUMBER, offset=_NUMBER, global_search=_FLAG, summary_mode=_TEXT)
def search_symbols(p: Project, query: str | None = None, symbol_name: str | None = None, kind: str | None = None, visibility: str | None = None, limit: int = 10, offset: int = 0, global_search: bool = False, summary_mode: str = "source") -> list[dict]:
    nodes = p.catalog.read("nodes").withColumn("source", F.col("repo"))
    sources = () if global_search else (p.repo,)
    vector = query_vector(p.provider, query) if p.provider is not None and query and p.catalog.versions("vectors") else None
    request = search.SearchRequest(text=query, vector=vector, name=symbol_name, kind=kind, visibility=visibility, sources=sources, limit=limit, offset=offset, boost_source=p.repo)
    index = SymbolIndex.of(p.catalog)
    vectors = p.catalog.read("vectors") if vector is not None else None
    page = search.search(nodes, request, id_col="id", text_col="fts_needle", vectors=vectors, vector_id="id", vector_col="vector", index=index if index.built() else None)
    order = [F.col("rrf").desc(), "id"] if query else [F.col("name").asc_nulls_last(), "id"]
    from tessera.operators.hierarchy import page_without_parents

    kept = page_without_parents(page, limit, *order).collect()
    bodies = p.hit_texts(kept, summary.Mode(summary_mode))
    return [{**{k: r[k] for k in ("name", "kind", "visibility", "path")}, "body": body} for r, body in zip(kept, bodies, strict=True)]


@tool("repo_map", "The files that matter most for symbols, files or a prompt.", symbol_names=_MANY, file_paths=_MANY, prompt=_TEXT, limit=_NUMBER, token_limit=_NUMBER, summary_mode=_TEXT, skip_mentioned_summary=_FLAG)
def repo_map(p: Project, symbol_names: list[str] = (), file_paths: list[str] = (), prompt: str | None = None, limit: int = 20, token_limit: int | None = None, summary_mode: str = "skip", skip_mentioned_summary: bool = False) -> list[dict]:
    files, nodes, refs = p.catalog.read("files"), p.catalog.read("nodes"), p.catalog.read("refs")
    names, places = set(symbol_names), set(file_paths)
    if prompt:
        places |= {r.path for r in graph.mentioned_files(files, prompt).select("path").collect()}
        every = nodes.where("name IS NOT NULL").select("name").union(refs.select("name")).distinct()
        names |= {r.name for r in graph.mentioned_names(every, prompt).collect()}
    seeds = [graph.SYMBOL + n for n in sorted(names)] + sorted(places)
    ranks = graph.pagerank(CodeGraph.read(p.catalog), seeds or None, rounds=50)
    best = graph.top_files(ranks, limit).collect()
    shown = [r.path for r in best if not (skip_mentioned_summary and r.path in places)]
    texts = p.summaries(shown, summary_mode)
    out, used = [], 0
    for r in best:
        row = {"file_path": r.path, "score": round(r.score, 6), "summary": texts.get(r.path)}
        used += p.count_tokens(render.as_text(row))
        if token_limit is not None and used > token_limit:
            break
        out.append(row)
    return out
