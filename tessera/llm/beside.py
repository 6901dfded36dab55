"""Rows by the place they have in files, and tables that lie beside them.

What an operator finds out about documents has to meet their texts again. A join
would shuffle every text, so a document is named by its file and its row there,
which a scan gives for nothing, and what was found is written to the shared
folder in slots by that name. A later scan reads for each window of rows only
the part of a slot that belongs to it. This doesn't depend on how a scan is cut
into tasks, nor on which executor runs them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import ease, kept, shared_dir, written
from tessera.llm.textcore import chunks

#: Rows of a window, as a power of two.
WINDOW = 14
#: Bytes of a row group of a slot, about what a window has, so that reading one window doesn't read its neighbours.
ROW_GROUP = 8 << 20
#: Plans in which a row of the result is a row of a file.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def _scans(docs: DataFrame) -> bool:
    """Whether every row of docs is a row of a file, the same on each run."""
    nodes = [docs._jdf.queryExecution().analyzed()]
    if not nodes[0].deterministic():
        return False
    for node in nodes:
        if node.getClass().getSimpleName() not in _PLAIN:
            return False
        below = node.children()
        nodes += [below.apply(k) for k in range(below.size())]
    return True


def placed(docs: DataFrame, file: str = "file", row: str = "row") -> DataFrame:
    """docs with the hash of the file and the number of the row that each row is read from; what isn't a scan of files is written first."""
    for source in (docs, None):
        if source is None:
            source = written(docs, "rows")
        elif not _scans(docs):
            continue
        try:
            of = source.metadataColumn("_metadata")
            return source.select("*", F.xxhash64(of["file_path"]).alias(file), of["row_index"].alias(row))
        except AnalysisException:  # a source without places
            if source is not docs:
                raise
    raise AssertionError


def windows(batches: Iterator[pa.RecordBatch], rows: int = 1024, most: int = 1 << 19, column: str = "text", file: str = "file", row: str = "row") -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Slices of bounded size, each of one window: file, number of the window, rows."""
    for b in chunks(batches, column, most, rows):
        files, numbers = b.column(file).to_numpy(), b.column(row).to_numpy() >> WINDOW
        cut = np.flatnonzero((files[1:] != files[:-1]) | (numbers[1:] != numbers[:-1])) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            yield int(files[a]), int(numbers[a]), b.slice(a, z - a)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's view of a folder that Hadoop names."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


class Side:
    """A table with file and row, laid down in slots; workers read it by window."""

    def __init__(self, path: str, slots: int, names: list[str]):
        self.path, self.slots, self.names = path, slots, names

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("path", "slots", "names")}

    def read(self, file: int, window: int) -> pa.Table | None:
        """Rows of a window, sorted by row; None if there are none."""
        if not hasattr(self, "_fs"):
            self._fs, self._at = filesystem(self.path)
        where = f"{self._at}/slot={(file ^ window) % self.slots}"
        if self._fs.get_file_info(where).type != pafs.FileType.Directory:
            return None
        low = window << WINDOW
        f, r = pc.field("file"), pc.field("row")
        got = pads.dataset(where, filesystem=self._fs, format="parquet").to_table(filter=(f == file) & (r >= low) & (r < low + (1 << WINDOW)))
        return got.sort_by("row") if got.num_rows else None


def lay(df: DataFrame, name: str, slots: int) -> Side:
    """df, which has file and row, written to the shared folder in so many slots."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    slot = F.pmod(F.col("file").bitwiseXOR(F.shiftright("row", WINDOW)), F.lit(slots)).cast("int")
    placed = df.withColumn("slot", slot).repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "file", "row")
    placed.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("slot").parquet(path)
    kept(spark, path)
    ease(spark)
    return Side(path, slots, df.columns)
