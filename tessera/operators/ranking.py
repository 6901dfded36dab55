"""Ranks over a whole table without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stored

#: monotonically_increasing_id: the partition above these bits, the place in it below.
PLACE_BITS = 33


def global_rank(df: DataFrame, score: str, tie: str, rank: str) -> DataFrame:
    """df with the row number by score, highest first, then tie, as column `rank`.

    Rows are parted by ranges of (score, tie), so equal scores spread as well,
    and sorted within a part; a row's rank is its place there and the number of
    rows in the parts before. df is computed once for the ranges' ends and once
    to be sorted, and should be narrow; a row for each part is all that's gathered.
    """
    order = F.col(score).desc(), F.col(tie).asc_nulls_last()
    numbered = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_n", PLACE_BITS), F.col("_n").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # as many rows as the exchange has partitions
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    return numbered.withColumn("_part", part).join(offsets, "_part").withColumn(rank, (F.col("_before") + place + 1).cast("long")).drop("_part", "_before", "_n")


def top(df: DataFrame, limit: int, *order: Column, offset: int = 0) -> DataFrame:
    """Rows offset..offset+limit in the given order."""
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
