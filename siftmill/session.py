"""Session helpers: a local session for tests and benches, and reliable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Row groups of tables written in parts: a part is often read alone, and a reader cannot cut a row group.
PART_GROUP_BYTES = 8 << 20
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "siftmill", memory: str = "8g") -> SparkSession:
    """Local session used by the tests and ``bench.py``; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the one the cluster names. A local session without one gets a
    folder of its own, one for each application, which goes when the process ends."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared scratch space; every executor reaches it by this address."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_parts(df: DataFrame, partition_by: tuple[str, ...], path: str) -> None:
    """Write ``df`` to ``path``; parts get small row groups, so that all cores share the reading of one."""
    writer = df.write.partitionBy(*partition_by)
    (writer.option("parquet.block.size", PART_GROUP_BYTES) if partition_by else writer).parquet(path)


def cut_lineage(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Used where a later step scans the same intermediate several times or where row ids must
    not change when a lost executor's work is redone.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    write_parts(df, partition_by, path)
    return spark.read.schema(df.schema).parquet(path)
