"""The graph of files and the names they define and refer to, and ranking on it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import basename, descriptiveness
from tessera.session import stored

DEF_WEIGHT, REF_WEIGHT = 3.0, 1.0
SELF_WEIGHT, LEAST_WEIGHT = 0.3, 1e-9
DESCRIPTIVE = 4.0
HIDDEN = 0.1
MANY_DEFS, MANY_DEFS_FACTOR = 5, 0.1
RESTART = 0.15
SYMBOL = "sym::"
#: Ways out of a node that are kept in one row.
LIST = 4096


def name_weights(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, n_defs, n_refs, weight). defs: (path, name, visibility); refs: (path, name).

    A name weighs more the more it tells and the more files refer to it, less if
    it is hidden or defined in many places. Properties come from the last
    definition in order of path.
    """
    d = defs.groupBy("name").agg(F.count_distinct("path").alias("n_defs"), F.max_by("visibility", "path").alias("visibility"))
    r = refs.groupBy("name").agg(F.count_distinct("path").alias("n_refs"))
    both = d.join(r, "name", "full").select("name", F.coalesce("n_defs", F.lit(0)).alias("n_defs"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"), "visibility")
    base = F.when(F.col("n_defs") > 0, descriptiveness(F.col("name")) * F.lit(DESCRIPTIVE) * F.when(F.col("visibility").isin("private", "protected"), F.lit(HIDDEN)).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    base = base * F.when(F.col("n_defs") >= MANY_DEFS, F.lit(MANY_DEFS_FACTOR)).otherwise(F.lit(1.0))
    weight = base * F.when(F.col("n_refs") > 0, F.log1p(F.col("n_refs").cast("double"))).otherwise(F.lit(1.0))
    return both.select("name", "n_defs", "n_refs", F.when(weight > 0, weight).otherwise(F.lit(LEAST_WEIGHT)).alias("weight"))


def symbol_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges (name, src, dst, weight): files to the names they refer to and define, names to the files that define them. Those of a name follow from its own definitions and references."""
    weights = name_weights(defs, refs).select("name", "weight")
    symbol = F.concat(F.lit(SYMBOL), F.col("name"))
    r = refs.select("path", "name").distinct().join(weights, "name")
    d = defs.select("path", "name").distinct().join(weights, "name")
    edges = (
        r.select("name", F.col("path").alias("src"), symbol.alias("dst"), (F.col("weight") * F.lit(REF_WEIGHT)).alias("weight"))
        .unionByName(d.select("name", F.col("path").alias("src"), symbol.alias("dst"), (F.col("weight") * F.lit(DEF_WEIGHT)).alias("weight")))
        .unionByName(d.select("name", symbol.alias("src"), F.col("path").alias("dst"), (F.col("weight") * F.lit(DEF_WEIGHT)).alias("weight")))
    )
    return edges.groupBy("name", "src", "dst").agg(F.sum("weight").alias("weight"))


def refreshed_edges(edges: DataFrame, defs: DataFrame, refs: DataFrame, changed: DataFrame) -> DataFrame:
    """symbol_edges after the files in changed (path) have changed, from those before: only names that these files had or have are computed anew."""
    had = edges.join(changed.select(F.col("path").alias("src")), "src", "left_semi").select("name").union(edges.join(changed.select(F.col("path").alias("dst")), "dst", "left_semi").select("name"))
    have = defs.select("path", "name").union(refs.select("path", "name")).join(changed.select("path"), "path", "left_semi").select("name")
    names = had.union(have).distinct()
    return edges.join(names, "name", "left_anti").unionByName(symbol_edges(defs.join(names, "name", "left_semi"), refs.join(names, "name", "left_semi")).select(*edges.columns))


def with_loops(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight), with one from each node without a way out to itself."""
    merged = edges.select("src", "dst", "weight")
    nodes = files.select(F.col("path").alias("src")).union(merged.select("dst")).distinct()
    ends = nodes.join(merged.select("src").distinct(), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(SELF_WEIGHT).alias("weight"))
    return merged.unionByName(ends)


def code_graph(files: DataFrame, defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges (src, dst, weight): files to the names they refer to and define, names to the files that define them; a node without a way out leads to itself."""
    return with_loops(files, symbol_edges(defs, refs))


def _lists(edges: DataFrame) -> DataFrame:
    """(src, to): the ways out of a node with their shares, in lists of about LIST, so that a node that many lead to and from is in many tasks."""
    ways = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.ceil(F.count("*") / F.lit(LIST)).alias("n"))
    part = F.pmod(F.xxhash64("dst"), F.col("n")).alias("part")
    shares = edges.join(ways, "src").select("src", part, "dst", (F.col("weight") / F.col("total")).alias("p"))
    return shares.groupBy("src", "part").agg(F.collect_list(F.struct("dst", "p")).alias("to")).select("src", "to")


def pagerank(edges: DataFrame, seeds: list[str] | None = None, restart: float = RESTART, rounds: int = 20, cut_every: int = 10) -> DataFrame:
    """(node, score) of a random walk with restart, at the seeds or anywhere. Seeds that are not in the graph don't count; if none is, ValueError.

    A round joins the ranks to lists of ways out, a row for a node but for large ones, and shuffles what they add up to by task.
    """
    steps = stored(_lists(edges), "steps")
    nodes = steps.select(F.col("src").alias("node")).union(steps.select(F.explode("to.dst"))).distinct()
    if seeds:
        wanted = nodes.withColumn("mass", F.when(F.col("node").isin(sorted(set(seeds))), 1.0).otherwise(0.0))
    else:
        wanted = nodes.withColumn("mass", F.lit(1.0))
    wanted = stored(wanted, "nodes")
    count, mass = wanted.agg(F.count("*"), F.sum("mass")).first()
    if not mass:
        raise ValueError("no seed is in the graph")
    base = wanted.select("node", (F.col("mass") / F.lit(mass)).alias("home"))
    rank = base.select("node", F.lit(1.0 / count).alias("r"))
    for i in range(rounds):
        moved = steps.join(rank, steps.src == rank.node).select("r", F.inline("to")).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("s"))
        rank = base.join(moved, base.node == moved.dst, "left").select("node", (F.lit(restart) * F.col("home") + F.lit(1 - restart) * F.coalesce("s", F.lit(0.0))).alias("r"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            rank = stored(rank, "ranks")
    return rank.select("node", F.col("r").alias("score"))


def top_files(ranks: DataFrame, limit: int = 20) -> DataFrame:
    """The best files, leaving names out."""
    return ranks.where(~F.col("node").startswith(SYMBOL)).select(F.col("node").alias("path"), "score").orderBy(F.col("score").desc(), F.col("path").asc()).limit(max(1, limit))


def prompt_tokens(prompt: str, least: int = 3) -> list[str]:
    """Names that a prompt may mean: its identifiers in lower case, and what follows their last dot."""
    out = []
    for token in re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", prompt.lower()):
        token = token[:-1] if token.endswith(".") else token
        for t in (token, token.rsplit(".", 1)[-1]):
            if len(t) >= least:
                out.append(t)
    return list(dict.fromkeys(out))


def mentioned_names(names: DataFrame, prompt: str, name_col: str = "name", least: int = 3) -> DataFrame:
    """Names that the prompt mentions, whatever the case."""
    return names.where(F.lower(name_col).isin(prompt_tokens(prompt, least)))


def mentioned_files(files: DataFrame, prompt: str, path_col: str = "path") -> DataFrame:
    """Files whose path or name occurs in the prompt."""
    text = F.lit(prompt.lower())
    return files.where((F.instr(text, F.lower(path_col)) > 0) | (F.instr(text, F.lower(basename(F.col(path_col)))) > 0))


def within_budget(ranked: DataFrame, cost: str, budget: int, *order) -> DataFrame:
    """The first rows whose running cost stays within the budget; `ranked` is what a page or summary list holds."""
    running = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", running).where(F.col("running") <= budget)


