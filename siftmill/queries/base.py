"""Query registry: each query is a Spark callable and, where SQL can say the same, its ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the operator ids it exercises."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name], COVERS[name] = fn, covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round result columns so that engines agree; adding 0.0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def hash_mod(seed: str, key: str, modulo: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % modulo


def sql_hash_mod(seed: str, key: str, modulo: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {modulo})"


def r(expr: str, digits: int = 6) -> str:
    """SQL text of a rounded double."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
