"""Spark helpers shared by the operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.plans.sizing import broadcast_if_small, input_bytes
from siftmill.session import cut_lineage, scratch_root

#: Compressed input bytes of a block of rows; the number of blocks stays a bounded summary.
BLOCK_BYTES = 16 << 20
MOST_BLOCKS = 20_000

_HELD: dict[str, Any] = {}

ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks that ``df`` is cut into; the work of a block is streamed."""
    return max(1, min(MOST_BLOCKS, -(-input_bytes(df) // block_bytes)))


def in_order(df: DataFrame, key: str, n: int, *ties: Column) -> DataFrame:
    """Rows in ``n`` partitions by ranges of ``key``, each sorted; null keys come first and ties
    are settled by ``ties``, so a retried task sees its rows in the same order."""
    return df.repartitionByRange(n, F.col(key).asc_nulls_first(), *ties).sortWithinPartitions(F.col(key).asc_nulls_first(), *ties)


def salted_rank(df: DataFrame, by: str, order: list[str], salts: int = 256, rank: str = "rank") -> DataFrame:
    """Rank from 0 of each row among those of equal ``by``, balanced when one value is frequent.

    Rows are dealt to ``salts`` parts per value, ranked inside a part, and shifted by the counts
    of the parts before. ``df`` is read twice and must not change between the reads.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = dealt.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(by, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)) - 1
    ranked = dealt.withColumn("_inside", inside).join(shifts, [by, "_salt"])
    return ranked.withColumn(rank, (F.col("_before") + F.col("_inside")).cast("long")).drop("_salt", "_inside", "_before")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared scratch space; every executor reaches it by this address."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in the only column of ``gone``; rows without a key stay
    unless ``gone`` holds null. The keys are written first and broadcast only if they are few."""
    name = f"_gone_{uuid.uuid4().hex}"
    keys = cut_lineage(gone.toDF(name).distinct())
    return df.join(broadcast_if_small(keys), df[key].eqNullSafe(F.col(name)), "left_anti")


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between its tasks under ``name``. It keeps one thing: that of other work goes first."""
    if name not in _HELD:
        forget()
        _HELD[name] = make()
    return _HELD[name]


def forget() -> None:
    """Drop what the worker has kept for other work, and give its memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def arrow_out(rows: dict, types: T.StructType) -> pa.RecordBatch:
    """Record batch with the columns of ``types``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(types)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) if not isinstance(rows[f.name], pa.Array) else rows[f.name].cast(f.type) for f in wanted], schema=wanted)


__all__ = ["BLOCK_BYTES", "arrow_out", "blocks", "cut_lineage", "forget", "held", "in_order", "read", "salted_rank", "schema", "shared_folder", "without"]
