"""Run a stream over what is there now and hand back the table it wrote."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


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


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of files: the part files of its folder, or its single file."""
    path = os.path.join(sf_dir, f"{table}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 100)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _run(stream: DataFrame, folder: str, mode: str, write: Callable[[DataFrame, int], None]) -> list[dict]:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", os.path.join(folder, "checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return [dict(p) for p in query.recentProgress]


def _rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    schema = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(os.path.join(folder, "rows"))


def drain(stream: DataFrame, name: str, mode: str, progress: list[dict] | None = None) -> DataFrame:
    """Run to the end of the input; return every row written, with its batch.

    Batches go to parquet, one folder per batch, so a batch that is run again
    replaces its own rows.  The progress of the batches is added to `progress`.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    done = _run(stream, folder, mode, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
    if progress is not None:
        progress += done
    return _rows(spark, folder, stream.schema)


def fold(
    stream: DataFrame,
    name: str,
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    state: str,
    folder: str | None = None,
) -> DataFrame:
    """Run `step` over the micro-batches with a keyed table as its state; return every row written, with its batch.

    `step` takes a micro-batch and the state before it, a table of the schema
    `state`, and returns the rows to write and the state after it.  Rows and state
    of a batch are written under its number, and a batch only reads the state of the
    number before, so a batch that is run again does the same again.  States older
    than that are removed.  With the `folder` of an earlier run the stream goes on
    where that ended.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        before = own.read.schema(state).parquet(f"{folder}/state/{n - 1}") if n else own.createDataFrame([], state)
        rows, after = step(batch, before)
        # The micro-batch is read twice, for its rows and for the state that it leaves.
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        after.write.mode("overwrite").parquet(f"{folder}/state/{n}")
        old = own._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{n - 2}")
        old.getFileSystem(own._jsc.hadoopConfiguration()).delete(old, True)

    rows_schema = step(spark.createDataFrame([], stream.schema), spark.createDataFrame([], state))[0].schema
    _run(stream, folder, "append", write)
    return _rows(spark, folder, rows_schema)
