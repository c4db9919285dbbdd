"""Shared folders, written intermediate tables and numpy sums over tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares for checkpoints.

    Only a local session may go without the setting; it then gets a temporary
    folder, which all its tasks see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="prosegauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, "prosegauge", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def summed_arrays(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all tasks of the array of `size` numbers that `count` makes of each task's batches.

    Tasks send one compressed array each; they are added in a tree, two at a
    time, so no task and not the driver holds many of them.  Unsigned numbers stop at
    their largest value.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"array": [zlib.compress(count(batches).astype(kind, copy=False), 1)]})

    def added(left: bytes | None, right: bytes | None) -> bytes | None:
        if left is None or right is None:
            return right if left is None else left
        one = np.frombuffer(zlib.decompress(left), kind)
        total = one + np.frombuffer(zlib.decompress(right), kind)
        if total.dtype.kind == "u":
            total[total < one] = np.iinfo(total.dtype).max
        return zlib.compress(total, 1)

    rows = df.mapInArrow(one, "array binary").rdd.map(lambda row: bytes(row["array"]))
    total = rows.treeAggregate(None, added, added, depth=2) if rows.getNumPartitions() else None
    return np.zeros(size, kind) if total is None else np.frombuffer(zlib.decompress(total), kind)
