"""Two-pass external shuffle into shards.

Pass one scatters rows uniformly into buckets that fit in memory, by a seeded
hash of the whole row; rows that are equal in all columns are numbered, and
their numbers are hashed too, so that copies are scattered like any other rows.
Pass two reads the buckets in order, each in a canonical order of its rows, and
applies a seeded Fisher-Yates shuffle. One exchange of the data, and the same
result for the same rows, seed and number of buckets, wherever rows came from
and however often a task is retried.

An exchange has at most MOST_PARTS partitions. With more buckets a partition has
several, side by side, sorted there by bucket; memory is needed for one of them
at a time, however large the table.

Defined results. Rows with nulls, empty or very long texts are rows like any
other. Repeated rows are rows of their own, each with shard and position.
An empty table gives no rows. `shard` and `position` come last; if the input
has columns of these names, an underscore is appended to ours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm import beside
from tessera.llm.cluster import free_name, joined_by_size, lean, small_batches, written

SEED = 20240611
#: Bytes of text in a bucket, on average. A bucket is held in a Python worker two or three times over.
BUCKET_BYTES = 24 << 20
#: Partitions of the exchange, at most.
MOST_PARTS = 20_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n); the same for the same arguments."""
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    order = list(range(n))
    picks = (draws * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _bucket_shuffler(seed: int, shard: str, inner: list[str], position: str, most: int = 4 << 20) -> Callable:
    """Rows come sorted by shard, and within it in canonical order."""

    def shuffled(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        rows = fisher_yates(table.num_rows, seed, bucket)
        step = max(1, int(len(rows) * most / max(1, table.nbytes)))
        for at in range(0, len(rows), step):
            part = table.take(pa.array(rows[at : at + step]))
            yield from part.append_column(position, pa.array(np.arange(at, at + part.num_rows, dtype=np.int64))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            shards = b.column(shard).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), b.num_rows]
            b = b.drop_columns(inner)
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if held and last != shards[a]:
                    yield from shuffled(int(last), held)
                    held = []
                last = shards[a]
                held.append(b.slice(a, z - a))
        if held:
            yield from shuffled(int(last), held)

    return run


def _row_hash(docs: DataFrame, seed: int) -> Column:
    hashable = [F.col(f"`{c}`") if not kind.startswith("map") else F.map_entries(f"`{c}`") for c, kind in docs.dtypes]
    hashable = [F.to_json(F.struct(c.alias("v"))) if "map<" in kind else c for c, (_, kind) in zip(hashable, docs.dtypes, strict=True)]
    return F.xxhash64(F.lit(seed), *hashable)


def _numbered(keys: DataFrame, total: int) -> DataFrame | None:
    """(file, row, ordinal) of rows with an equal one before them in (file, row); None if there are none. keys: file, row, key."""
    again = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    order = "key", "file", "row"
    place = F.monotonically_increasing_id()
    some = written(joined_by_size(keys, again, ["key"], "n", total).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", place), "repeated")
    many = some.count()
    if not many:
        return None
    part = F.shiftright("at", 33)
    counts = some.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # as many rows as the exchange has partitions
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    global_at = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("at")
    some = some.withColumn("part", part).join(F.broadcast(counts.select("part", before.alias("before"))), "part").select("file", "row", "key", global_at)
    heads = some.groupBy("key").agg(F.min("at").alias("head"), F.count("*").alias("n"))
    return joined_by_size(some, heads, ["key"], "n", many).select("file", "row", (F.col("at") - F.col("head")).alias("ordinal")).where("ordinal > 0")


def _with_ordinals(side: beside.Side, file: str, row: str, ordinal: str, column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for f, window, b in beside.windows(batches, column=column, file=file, row=row):
            if at != (f, window):
                at, got = (f, window), side.read(f, window)
                known = {} if got is None else dict(zip(got.column("row").to_pylist(), got.column("ordinal").to_pylist(), strict=True))
            numbers = [known.get(r, 0) for r in b.column(row).to_pylist()]
            yield b.append_column(ordinal, pa.array(numbers, pa.int64()))

    return run


def shuffle_into_shards(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, shards: int | None = None) -> DataFrame:
    """The rows of docs with shard and position; `shards` defaults to as many as bucket_bytes asks for."""
    small_batches(docs.sparkSession)
    shard, position = free_name(docs, "shard"), free_name(docs, "position")
    file, row, key, ordinal, part = (free_name(docs, n) for n in ("in_file", "in_row", "row_hash", "ordinal", "part"))
    texts = [c for c, kind in docs.dtypes if kind == "string"]
    keyed = beside.placed(docs.withColumn(key, _row_hash(docs, seed)), file, row)
    size = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in texts), F.lit(16).cast("long"))
    keys = written(keyed.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col(key).alias("key"), size.alias("size")), "row-keys")
    rows, total = keys.agg(F.count("*"), F.sum("size")).first()
    if shards is None:
        shards = max(1, -(-int(total or 0) // bucket_bytes))
    numbered = _numbered(keys.drop("size"), rows)
    if numbered is None:
        keyed = keyed.withColumn(ordinal, F.lit(0).cast("long"))
    else:
        side = beside.lay(numbered, "ordinals", max(1, -(-rows >> beside.WINDOW)))
        column = free_name(docs, "text_of_row")
        schema = T.StructType([*keyed.schema.fields, T.StructField(column, T.StringType()), T.StructField(ordinal, T.LongType())])
        keyed = keyed.withColumn(column, F.lit("")).mapInArrow(lean(_with_ordinals(side, file, row, ordinal, column)), schema)
    each = -(-shards // MOST_PARTS)
    keyed = keyed.withColumn(shard, F.pmod(F.xxhash64(F.lit(seed), key, ordinal), F.lit(shards)).cast("int")).withColumn(part, F.floor(F.col(shard) / F.lit(each)).cast("int"))
    scattered = keyed.select(*[F.col(f"`{c}`") for c in docs.columns], key, ordinal, part, shard).repartitionById(-(-shards // each), F.col(part)).sortWithinPartitions(shard, key, ordinal)
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(position, T.LongType())])
    return scattered.mapInArrow(lean(_bucket_shuffler(seed, shard, [key, ordinal, part], position)), schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled rows as Parquet, one directory per shard, in shuffled order."""
    out = shuffle_into_shards(docs, **options)
    out.write.partitionBy(free_name(docs, "shard")).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
