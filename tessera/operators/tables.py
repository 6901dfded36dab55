"""Tables as immutable snapshots: lookups, patches, and differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def by_id(df: DataFrame, value, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == F.lit(value)).limit(1)


def by_ids(df: DataFrame, values: list, id_col: str = "id", most: int = 1000) -> DataFrame:
    """Rows with any of the ids; a long list becomes a join."""
    if not values:
        return df.limit(0)
    if len(values) <= most:
        return df.where(F.col(id_col).isin(list(values)))
    wanted = df.sparkSession.createDataFrame([(v,) for v in set(values)], T.StructType([T.StructField(id_col, df.schema[id_col].dataType)]))
    return df.join(wanted, id_col, "left_semi")


def equal_to(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal in every column given; None doesn't filter, a list means any of it, an empty list nothing."""
    for name, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(list(value))) if value else df.limit(0)
        else:
            df = df.where(F.col(name) == F.lit(value))
    return df


def tri_state(df: DataFrame, column: str, present: bool | None) -> DataFrame:
    """Rows where the column is there, isn't, or either."""
    if present is None:
        return df
    return df.where(F.col(column).isNotNull() if present else F.col(column).isNull())


def appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with some of the columns; the rest is null."""
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def insert_ignore(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """df with those rows whose key it doesn't have; of rows with one key, one."""
    fresh = rows.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti")
    return appended(df, fresh)


def patched(df: DataFrame, patch: DataFrame, id_col: str = "id") -> DataFrame:
    """df with the columns of `patch` put in where ids are equal and the new value isn't null; unknown ids are passed over."""
    columns = [c for c in patch.columns if c != id_col]
    new = patch.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, df[id_col] == new["_id"], "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), df[c]).alias(c) if c in columns else df[c] for c in df.columns])


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """df less the rows whose key is in `gone`."""
    return df.join(gone.select(*keys), keys, "left_anti")


def upserted(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """df with `rows` in place of those with their keys, and the others of `rows` added."""
    return without(df, rows, keys).unionByName(rows.select(*df.columns))


def orphans(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents that no child refers to."""
    return parents.join(children.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): created, deleted, updated or same, comparing nulls as equal."""
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in keys + values], F.lit(1).alias("_o"))
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in keys + values], F.lit(1).alias("_n"))
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}"))
    same: Column = F.lit(True)
    for v in values:
        same = same & F.col(f"_o_{v}").eqNullSafe(F.col(f"_n_{v}"))
    change = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "deleted").when(same, "same").otherwise("updated")
    pick = [F.when(F.col("_n").isNotNull(), F.col(f"_n_{k}")).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys]
    return o.join(n, on, "full").select(*pick, change.alias("change"))


def changed_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change) of files by (path, mtime, hash): new, touched (time only), changed, same, gone. Only new and changed ones are parsed again."""
    s = stored.select("path", F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"), F.lit(1).alias("_s"))
    f = found.select("path", "mtime", "hash", F.lit(1).alias("_f"))
    change = (
        F.when(F.col("_f").isNull(), "gone")
        .when(F.col("_s").isNull(), "new")
        .when(F.col("mtime").eqNullSafe(F.col("_mtime")), "same")
        .when(F.col("hash").eqNullSafe(F.col("_hash")), "touched")
        .otherwise("changed")
    )
    return s.join(f, "path", "full").select("path", change.alias("change"))


def newest(df: DataFrame, size: int, by: str, partition: list[str], *tie: str, batch: int = 0) -> DataFrame:
    """At most `size` newest rows of each partition; if there are more, at least `batch` of the oldest go. Rows without a time go first."""
    w = Window.partitionBy(*partition)
    order = w.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc() for t in tie])
    n = F.count("*").over(w)
    keep = F.when(n > size, F.least(F.lit(size), n - F.lit(batch))).otherwise(n)
    return df.withColumn("_nth", F.row_number().over(order)).withColumn("_keep", keep).where(F.col("_nth") <= F.col("_keep")).drop("_nth", "_keep")


def reused(rows: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the value that is stored under their keys, or null."""
    kept = stored.groupBy(*keys).agg(F.max(value).alias(value))
    return rows.join(kept, keys, "left")


def suffix_stats(df: DataFrame, kind: str, seconds: str) -> DataFrame:
    """(kind, n, total, mean)."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"))


class Catalog:
    """Named Parquet tables under one folder, each a series of snapshots. The newest manifest says which snapshots belong together; of tables that no manifest names the newest that is complete counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _complete(self, name: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.root}/{name}")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v") and fs.exists(path(s.getPath(), "_SUCCESS")))

    def manifest(self) -> dict[str, int]:
        """The snapshot of each table that was published."""
        have = self._complete("manifest")
        if not have:
            return {}
        return {r.name: r.version for r in self.spark.read.parquet(f"{self.root}/manifest/v{have[-1]}").collect()}

    def versions(self, name: str) -> list[int]:
        """Snapshots of a table, up to the one that readers get."""
        have, published = self._complete(name), self.manifest().get(name)
        return [v for v in have if published is None or v <= published]

    def _write(self, name: str, df: DataFrame, partition: list[str] | None = None) -> int:
        version = (self._complete(name) or [0])[-1] + 1
        df.write.mode("overwrite").partitionBy(*(partition or [])).parquet(f"{self.root}/{name}/v{version}")
        return version

    def publish(self, named: dict[str, DataFrame]) -> None:
        """The next snapshots of several tables; readers see all of them or none."""
        versions = {**self.manifest(), **{name: self._write(name, df) for name, df in named.items()}}
        self._write("manifest", self.spark.createDataFrame(sorted(versions.items()), "name string, version int").coalesce(1))

    def write(self, name: str, df: DataFrame, partition: list[str] | None = None) -> DataFrame:
        """The next snapshot; readers of earlier ones aren't disturbed."""
        version, published = self._write(name, df, partition), self.manifest()
        if name in published:
            self._write("manifest", self.spark.createDataFrame(sorted({**published, name: version}.items()), "name string, version int").coalesce(1))
        return self.spark.read.parquet(f"{self.root}/{name}/v{version}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        have = self.versions(name)
        if not have:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{version or have[-1]}")

    def migrate(self, steps: list[tuple[str, Callable[[Catalog], None]]]) -> list[str]:
        """Run the named steps that haven't run on this catalog, in order of name, and record each; the names of those that ran."""
        done = {r.name for r in self.read("migrations").collect()} if self.versions("migrations") else set()
        ran = []
        for name, step in sorted(steps, key=lambda s: s[0]):
            if name in done or name in ran:
                continue
            step(self)
            ran.append(name)
            self.write("migrations", self.spark.createDataFrame([(n,) for n in sorted(done.union(ran))], "name string").coalesce(1))
        return ran
