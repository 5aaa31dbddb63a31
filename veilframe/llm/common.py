"""Shared plumbing: tables, the shared folder, temporary tables and streaming over sorted Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"/tmp/checkpoints/veilframe-{spark.sparkContext.applicationId}"
    return at.rstrip("/")


class Workspace:
    """Temporary tables in the shared folder. A written table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str = "work"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "snappy").parquet(self.path(name))  # zstandard holds native buffers for each open writer
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 50_000) -> Iterator[pa.Table]:
    """Regroup batches that come sorted by ``keys`` so that no key is cut: tables of ``least`` rows or more, the last may be smaller.

    Holds one key's rows at most beyond ``least``; callers bound the rows of a key.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held)
        cut = last_key_start(table, keys)
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
        else:
            held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def last_key_start(table: pa.Table, keys: list[str]) -> int:
    """The row where the last key begins."""
    low, high = 0, table.num_rows - 1
    columns = [table.column(k) for k in keys]
    last = tuple(c[high].as_py() for c in columns)
    while low < high:  # the last key's rows are a suffix
        mid = (low + high) // 2
        if tuple(c[mid].as_py() for c in columns) == last:
            high = mid
        else:
            low = mid + 1
    return low


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal rows, and the length at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


class Forest:
    """Union-find over positions 0..n-1 fed with arrays of links; keeps the smallest position of each set as its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
            self.label = label

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A star to each set's label."""
        leaf = np.flatnonzero(self.label != np.arange(len(self.label)))
        return leaf, self.label[leaf]
