"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import dropped, joined_by_size, written


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node that each is connected to."""
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(names))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return names, names[label]
        low, high = np.minimum(lx, ly)[apart], np.maximum(lx, ly)[apart]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges (child, root), root < child, that connect what (a, b) connect."""
    node, root = local_components(a, b)
    child = node != root
    return node[child], root[child]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) with m, the smallest of a and all its b; a node with very many edges is no task of its own."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("m", "a").alias("m"), "n")
    return joined_by_size(edges, least, ["a"], "n", total)


def components(edges: DataFrame) -> DataFrame:
    """(key, component) for every node of edges (a, b); component: the smallest node connected to it.

    Alternating stars: all larger neighbours of a node move to its smallest one,
    then the smaller ones do. Rounds grow with the logarithm of the diameter, and
    each reads and writes a narrow table.
    """
    now = written(edges.select("a", "b").where("a <> b").mapInArrow(_folded, "a long, b long"), "edges")
    while n := now.count():
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = written(_with_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star")
        low = _with_least(star, star.count())
        flat = low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = written(flat, "edges")
        dropped(now, star)
        now = after
        # done when what is left are stars: each node has one edge up or some down, never both
        ends = now.select("a").union(now.select("b").distinct())
        if not ends.groupBy("a").count().where("count > 1").take(1):
            break
    top = now.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("key"), F.col("b").alias("component")).union(top)
