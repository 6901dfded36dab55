"""Files as a stream: each batch of new ones is put into a table, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import Catalog, upserted


def refresh(spark: SparkSession, folder: str, schema, checkpoint: str, apply: Callable[[DataFrame, int], None], file_format: str = "parquet") -> None:
    """Give what has arrived since the last call to `apply`, in batches, then stop. A batch that failed is given again with its number."""
    stream = spark.readStream.format(file_format).schema(schema).load(folder)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_into(catalog: Catalog, name: str, keys: list[str], newest_by: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps, for each key, the newest row. The same batch given twice changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), newest_by).alias("r")).select("r.*")
        catalog.write(name, upserted(catalog.read(name), last, keys) if catalog.versions(name) else last)

    return apply


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """A stream without rows whose keys came before, within the time that rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
