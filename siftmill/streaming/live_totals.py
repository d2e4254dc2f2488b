"""Run totals that follow the event log while it grows.

The result is a table with one folder a version. A batch of the stream writes the version of its
own number from the one before and the rows it has changed, and a version counts once its success
mark is there. A batch that is run again after a failure finds its version, or writes the same one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from siftmill.operators.runlog import PAYLOAD, USAGE_KEYS
from siftmill.sources.tables import path_exists

KEYS = ("task_id", "type")
#: Older versions than these are removed: readers of the last ones are not disturbed.
KEPT_VERSIONS = 3


def read_event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New event files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_totals(events: DataFrame) -> DataFrame:
    """Events, tokens, usage and state seconds per task and event type.

    Works on a batch and on a stream alike. The totals carry no time, so no watermark is needed;
    the state is one row per task and type.
    """
    pl = events.withColumn("pl", F.from_json("payload", PAYLOAD))
    item = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pl.groupBy("task_id", "type").agg(
        F.count("*").alias("n"), item(F.col("pl.tokens")).alias("tokens"), *[item(F.col(f"pl.usage.{k}")).alias(k) for k in USAGE_KEYS],
        F.sum(F.coalesce("pl.sec", F.lit(0.0))).alias("sec"),
    )


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(n for n in numbers if path_exists(spark, f"{version_path(folder, n)}/_SUCCESS"))


def version_path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/version={number:012d}"


def put_version(batch: DataFrame, number: int, folder: str, keys: Sequence[str] = KEYS) -> None:
    """Write version ``number``: the version before with the rows of ``batch`` in place of those of
    the same keys. A complete version is left alone."""
    spark = batch.sparkSession
    done = versions(spark, folder)
    if number in done:
        return
    before = [n for n in done if n < number]
    rows = batch
    if before:
        old = spark.read.parquet(version_path(folder, before[-1]))
        match = [old[k].eqNullSafe(batch[k]) for k in keys]
        rows = old.join(batch, match, "left_anti").unionByName(batch)
    rows.write.mode("overwrite").parquet(version_path(folder, number))
    for n in before[: 1 - KEPT_VERSIONS]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(version_path(folder, n))
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def write_totals(totals: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = KEYS) -> DataStreamWriter:
    """Writer of the changed totals of each batch as a new version, stopping when the present files are done."""
    put = lambda batch, number: put_version(batch, number, folder, keys)
    return totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The last complete version."""
    return spark.read.parquet(version_path(folder, versions(spark, folder)[-1]))
