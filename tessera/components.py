"""What a project derives from its catalog and keeps up to date with it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import embed, graph
from tessera.operators.search import TextIndex
from tessera.operators.tables import Catalog
from tessera.sources.repo import ingest


class Component:
    """Derived data. `refresh` gets the changes (path, change, repo) of one scan; a component without any data yet makes all of it."""

    name = "component"

    def initialize(self, catalog: Catalog) -> None:
        """Make everything from the catalog."""

    def refresh(self, catalog: Catalog, changes: DataFrame) -> None:
        """Follow the changes."""
        self.initialize(catalog)

    def destroy(self, catalog: Catalog) -> None:
        """Give up what is held."""


def _defs_refs(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    return catalog.read("nodes").where("name IS NOT NULL").select("path", "name", "visibility"), catalog.read("refs").select("path", "name")


class CodeGraph(Component):
    """Edges of files and names, by name; a refresh computes the names of changed files only."""

    name = "graph"

    def initialize(self, catalog: Catalog) -> None:
        catalog.write("edges", graph.symbol_edges(*_defs_refs(catalog)))

    def refresh(self, catalog: Catalog, changes: DataFrame) -> None:
        if catalog.versions("edges"):
            catalog.write("edges", graph.refreshed_edges(catalog.read("edges"), *_defs_refs(catalog), changes))
        else:
            self.initialize(catalog)

    @staticmethod
    def read(catalog: Catalog) -> DataFrame:
        """All edges, of the stored names if there are any."""
        edges = catalog.read("edges") if catalog.versions("edges") else graph.symbol_edges(*_defs_refs(catalog))
        return graph.with_loops(catalog.read("files").select("path"), edges)


class SymbolIndex(Component):
    """An inverted index of the symbols' texts."""

    name = "index"

    @staticmethod
    def of(catalog: Catalog) -> TextIndex:
        return TextIndex(catalog.spark, f"{catalog.root}/symbols", "id")

    def initialize(self, catalog: Catalog) -> None:
        self.of(catalog).build(catalog.read("nodes"), "fts_needle")

    def refresh(self, catalog: Catalog, changes: DataFrame) -> None:
        have = catalog.versions("nodes")
        if not self.of(catalog).built() or len(have) < 2:
            self.initialize(catalog)
            return
        some = lambda version: catalog.read("nodes", version).join(changes.select("path", "repo"), ["path", "repo"], "left_semi")
        self.of(catalog).refresh(some(have[-1]), some(have[-2]), "fts_needle")


class NodeVectors(Component):
    """Vectors of the symbols, from a cache by content where they were computed before; the cache keeps the newest `size`."""

    name = "vectors"

    def __init__(self, provider: embed.EmbeddingProvider, size: int = 1_000_000):
        self.provider, self.size = provider, size

    def initialize(self, catalog: Catalog) -> None:
        nodes = catalog.read("nodes").select("id", embed.node_text().alias("text"))
        cache = catalog.read("vector_cache") if catalog.versions("vector_cache") else catalog.spark.createDataFrame([], embed.CACHE)
        rows, kept = embed.with_vectors(nodes.where("text <> ''"), "text", self.provider, cache)
        catalog.publish({"vectors": rows.select("id", "vector"), "vector_cache": embed.trimmed(kept, self.size)})


class Workspace:
    """Repositories in one catalog, and the components that follow them.

    `refresh` scans the repository of a name, or all; one that was scanned less
    than `cooldown` seconds ago is left alone.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, roots: dict[str, str], components: list[Component] | None = None, cooldown: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.catalog, self.roots, self.cooldown, self.clock = spark, catalog, dict(roots), cooldown, clock
        self.components: dict[str, Component] = {}
        self.scanned: dict[str, float] = {}
        for c in components if components is not None else [CodeGraph(), SymbolIndex()]:
            self.add(c)

    def add(self, component: Component) -> None:
        """Register a component in place of the one with its name; over a catalog with data it is made at once."""
        if old := self.components.get(component.name):
            old.destroy(self.catalog)
        self.components[component.name] = component
        if self.catalog.versions("nodes"):
            component.initialize(self.catalog)

    def get(self, name: str) -> Component | None:
        return self.components.get(name)

    def refresh(self, repo: str | None = None, paths: list[str] | None = None, force: bool = False) -> dict[str, dict[str, int]]:
        """Scan and let all components follow; counts of changes for each repository that was scanned."""
        out = {}
        for name in [repo] if repo is not None else sorted(self.roots):
            now = self.clock()
            if not force and name in self.scanned and now - self.scanned[name] < self.cooldown:
                continue
            out[name] = ingest(self.spark, self.roots[name], self.catalog, name, paths)
            self.scanned[name] = now
            changes = self.catalog.read("changes")
            if changes.take(1):
                for component in self.components.values():
                    component.refresh(self.catalog, changes)
        return out

    def close(self) -> None:
        for component in self.components.values():
            component.destroy(self.catalog)
        self.components.clear()

