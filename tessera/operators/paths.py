"""Queries over file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import basename, glob_pattern, subsequence, trigrams

VIRTUAL_PREFIX = ".virtual-path"


def trigram_index(files: DataFrame, id_col: str, path_col: str) -> DataFrame:
    """(id, trigram), one row for each distinct trigram of a path in lower case."""
    return files.select(id_col, F.explode(trigrams(F.lower(path_col))).alias("trigram"))


def filename_complete(files: DataFrame, needle: str, path_col: str = "path", limit: int = 5, repo_ids: list[str] | None = None) -> DataFrame:
    """Files whose path holds the needle's characters in order, best first.

    Twenty points if the file's name alone holds them, ten for the path, two for
    each trigram in common, less a hundredth of a point for each character. All
    in one pass: trigrams of the needle are looked up in the path itself.
    """
    if not needle or repo_ids == []:
        return files.limit(0).withColumn("score", F.lit(0.0))
    low = needle.lower()
    path = F.lower(path_col)
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    pattern = subsequence(low)
    shared: Column = F.lit(0)
    for g in grams:
        shared = shared + F.when(F.instr(path, g) > 0, 1).otherwise(0)
    score = F.when(basename(path).rlike(pattern), 20.0).otherwise(0.0) + F.lit(10.0) + F.lit(2.0) * shared - F.length(path_col) / F.lit(100.0)
    rows = files.where(F.col("repo_id").isin(repo_ids)) if repo_ids is not None else files
    return rows.where(path.rlike(pattern)).withColumn("score", score).orderBy(F.col("score").desc(), F.col(path_col).asc()).limit(limit)


def matching(files: DataFrame, globs: list[str], path_col: str = "path") -> DataFrame:
    """Files that any glob matches; none if there are no globs."""
    if not globs:
        return files.limit(0)
    return files.where(F.col(path_col).rlike("|".join(glob_pattern(g) for g in globs)))


def virtual_path(repo: Column, path: Column, default_repo: str, by_project: bool = False) -> Column:
    """Path by which a file of any repository is known."""
    if by_project:
        return F.concat_ws("/", repo, path)
    return F.when(repo == default_repo, path).otherwise(F.concat_ws("/", F.lit(VIRTUAL_PREFIX), repo, path))


def physical_path(virtual: DataFrame, repos: DataFrame, default_repo: str, path_col: str = "virtual_path", by_project: bool = False) -> DataFrame:
    """Inverse of virtual_path: (repo, path) added, both null if the repository is unknown. `repos` has the names that are known."""
    v = F.col(path_col)
    if by_project:
        named, rest = F.split(v, "/", 2).getItem(0), F.regexp_extract(v, "^[^/]*/(.*)$", 1)
    else:
        other = v.startswith(VIRTUAL_PREFIX + "/")
        bare = F.substring(v, len(VIRTUAL_PREFIX) + 2, 1 << 20)
        named = F.when(other, F.split(bare, "/", 2).getItem(0)).otherwise(F.lit(default_repo))
        rest = F.when(other, F.regexp_extract(bare, "^[^/]*/(.*)$", 1)).otherwise(v)
    known = repos.select(F.col("name").alias("repo")).distinct()
    return virtual.withColumn("_named", named).withColumn("_rest", rest).join(known, F.col("_named") == F.col("repo"), "left").withColumn("path", F.when(F.col("repo").isNotNull(), F.col("_rest"))).drop("_named", "_rest")
