"""Shared folder, written tables and checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept(spark, path)
    ease(spark)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, path: str) -> None:
    """Have release() delete path."""
    _written.append((spark, path))


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written(); all that is made of them has to be written by now."""
    for df in tables:
        spark = df.sparkSession
        paths = {"/".join(f.split("/")[:-1]) for f in df.inputFiles()[:1]}
        for own in [x for x in _written if x[1].split("/")[-1] in {p.split("/")[-1] for p in paths}]:
            _written.remove(own)
            _delete(spark, own[1])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete all that written() has written; results that are still to be computed from it become unreadable."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster
            return


atexit.register(release)


def lean(run: Callable) -> Callable:
    """The function of a mapInArrow, giving its memory back when a task is done: workers live on and would hold it through other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def _trim_jvm(spark: SparkSession) -> None:
    """What jcmd's System.trim_native_heap does; by reflection, as the class of the server isn't exported."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def ease(spark: SparkSession, part: float = 0.5) -> None:
    """Give back what the driver has freed. It makes many plans and lives through all stages: a heap grown beyond `part` of its bound is collected, which also shrinks it, and what the C library of the JVM and of Python holds back is returned."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > part * heap.maxMemory():
        gc.collect()  # Python's handles keep plans alive
        jvm.java.lang.System.gc()
    try:
        _trim_jvm(spark)
    except Py4JJavaError:  # another JVM or C library
        pass
    _trim()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what Spark holds for a Python worker at once; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows. Ends as soon as one more is found."""
    return len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows


#: Keys that are joined by broadcast at most.
HOT = 1000


def joined_by_size(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left joined to right, which has one row for each key and in `weight` how many of the `total` rows of left have it.

    Keys of more than a HOT-th of all rows, fewer than HOT by arithmetic, are
    broadcast; the others are shuffled, and none of them is larger than that.
    """
    hot = F.col(weight) * F.lit(HOT) > F.lit(total)
    return left.join(F.broadcast(right.where(hot)), keys).unionByName(left.join(right.where(~hot), keys))


def with_small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, marked to be broadcast if it has been found to have few rows; otherwise Spark chooses a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_key() -> Column:
    """What tells documents apart: the identifier and the text. Rows equal in both are one document."""
    return F.xxhash64("doc_id", "text")


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)
