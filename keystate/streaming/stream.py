"""The change log as a stream: running state, and ingestion into a store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import KeyState
from ..operators.state import latest_version
from ..schema import PUT


def read_changes(spark: SparkSession, path: str, schema, files_at_once: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream of changes, each file once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def latest_updates(changes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Running latest versions, for update mode. The highest seq wins in whatever order
    changes arrive, so no watermark is needed; state grows with the number of keys."""
    return latest_version(changes, extra)


def updates_on_files(updates: DataFrame) -> DataFrame:
    """All updates that a stream puts out over what is there now, written by the tasks and
    read back; none goes to the driver. The folder is in ``spark.checkpoint.dir``, or of
    this machine in a local session."""
    spark = updates.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="keystate-")
    path = f"{folder.rstrip('/')}/keystate-stream-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # one that is run again replaces its files

    spark.createDataFrame([], updates.schema).write.parquet(f"{path}/out/batch=-1")  # a stream may put out nothing
    updates.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(updates.schema).parquet(f"{path}/out")


def settled(updates: DataFrame) -> DataFrame:
    """The visible state of all updates put out so far: the last one of a key decides."""
    return latest_version(updates).where(F.col("op") == PUT)


def ingest(changes: DataFrame, store: KeyState, name: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of (key, value, op, pos) into a store, each micro-batch once: the
    manifest keeps the number of the last batch, so one that is run again is passed over."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write(batch, name, number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
