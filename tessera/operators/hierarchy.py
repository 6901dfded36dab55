"""Forests kept as parent identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored


def with_children(hits: DataFrame, nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", kind_col: str | None = None) -> DataFrame:
    """(parent, child) of the direct children of hits; literals bring none."""
    parents = hits if kind_col is None else hits.where(~F.col(kind_col).eqNullSafe("literal"))
    of = parents.select(F.col(id_col).alias("parent")).distinct()
    return nodes.where(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias("parent"), F.col(id_col).alias("child")).join(of, "parent", "left_semi")


def ancestors(hits: DataFrame, nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", kind_col: str | None = None) -> DataFrame:
    """(id, ancestor, depth) for every ancestor of the hits; a literal parent ends the climb.

    Climbs by jumps of doubling length, so a chain of any depth takes rounds that
    grow with its logarithm. Parents that form a cycle are an error.
    """
    link = nodes.where(F.col(parent_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_parent"))
    if kind_col is not None:
        real = nodes.where(~F.col(kind_col).eqNullSafe("literal")).select(F.col(id_col).alias("_parent"))
        link = link.join(real, "_parent", "left_semi").select("_id", "_parent")
    jump = link = stored(link, "links")
    some = hits.select(F.col(id_col).alias("id")).distinct()
    up = stored(some.join(link, F.col("id") == F.col("_id")).select("id", F.col("_parent").alias("ancestor"), F.lit(1).alias("depth")), "up")
    reach, many = 1, None
    while True:
        more = stored(up.join(jump, F.col("ancestor") == F.col("_id")).select("id", F.col("_parent").alias("ancestor"), (F.col("depth") + F.lit(reach)).alias("depth")), "up")
        if not more.take(1):
            return up
        reach *= 2
        many = link.count() if many is None else many
        if reach > 2 * many:
            raise ValueError("parents form a cycle")
        up = stored(up.unionByName(more), "up")
        ahead = jump.select(F.col("_id").alias("_parent"), F.col("_parent").alias("_next"))
        jump = stored(jump.join(ahead, "_parent").select("_id", F.col("_next").alias("_parent")), "jump")


def page_without_parents(page: DataFrame, limit: int, *order, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The first `limit` hits of a page after dropping those that another hit of the page names as its parent."""
    named = page.where(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias(id_col)).distinct()
    return page.join(named, id_col, "left_anti").orderBy(*order).limit(limit)


def longest_prefix(rows: DataFrame, owners: DataFrame, name_col: str, owner_col: str, separator: str = ".", within: list[str] | None = None) -> DataFrame:
    """rows with the longest owner that is a proper prefix of the name up to a separator, or null.

    Every proper prefix of a name is made a row and joined by equality, so no
    pair of rows is compared that can't match.
    """
    keys = within or []
    parts = F.split(F.col(name_col), "\\" + separator if not separator.isalnum() else separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    some = rows.where(F.size(parts) > 1).select(*keys, name_col, F.explode(prefixes).alias(owner_col)).distinct()
    found = some.join(owners.select(*keys, owner_col).distinct(), [*keys, owner_col])
    best = found.groupBy(*keys, name_col).agg(F.max_by(owner_col, F.length(owner_col)).alias(owner_col))
    return rows.join(best, [*keys, name_col], "left")
