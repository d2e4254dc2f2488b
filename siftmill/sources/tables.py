"""Reading tables: CSV with full-scan type inference, computed columns, parquet cache, headers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Candidate types from narrow to wide, tried in this order.
CANDIDATE_TYPES = ("bigint", "double", "boolean", "date", "timestamp_ntz")


def read_text_table(spark: SparkSession, path: str | Sequence[str], null_values: Sequence[str] = (), **options) -> DataFrame:
    """CSV with every column as text; all ``null_values`` are NULL before any type is chosen."""
    raw = spark.read.options(header=True, **options).csv(path)
    if not null_values:
        return raw
    return raw.select(*[F.when(F.col(f"`{c}`").isin(*null_values), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def infer_types(text: DataFrame) -> dict[str, str]:
    """Narrowest type that every filled value of a column parses as: one pass over all rows."""
    aggs = []
    for i, c in enumerate(text.columns):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"n{i}"))
        aggs += [F.count(F.expr(f"try_cast(trim(`{c}`) as {t})")).alias(f"n{i}_{t}") for t in CANDIDATE_TYPES]
    row = text.agg(*aggs).first()
    return {c: next((t for t in CANDIDATE_TYPES if row[f"n{i}"] and row[f"n{i}_{t}"] == row[f"n{i}"]), "string") for i, c in enumerate(text.columns)}


def read_table(spark: SparkSession, path: str | Sequence[str], null_values: Sequence[str] = (), schema: StructType | None = None, **options) -> DataFrame:
    """CSV table with inferred types, or with a declared schema (no inference pass)."""
    text = read_text_table(spark, path, null_values, **options)
    types = infer_types(text) if schema is None else {f.name: f.dataType.simpleString() for f in schema.fields}
    return text.select(*[F.expr(f"try_cast(trim(`{c}`) as {types[c]})").alias(c) if types[c] != "string" else F.col(f"`{c}`") for c in text.columns if c in types])


def with_aliases(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Computed source columns visible to later expressions."""
    return df.withColumns({k: F.expr(v) for k, v in expressions.items()})


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system the path belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write once, read ever after. The success marker tells a finished copy from a broken one."""
    spark = df.sparkSession
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line only."""
    return spark.read.option("header", True).csv(path).columns


def column_union(headers: Sequence[Sequence[str]]) -> list[str]:
    """Ordered distinct union of the columns of several tables."""
    return list(dict.fromkeys(c for h in headers for c in h))


def write_report_json(df: DataFrame, path: str) -> None:
    """Small result table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
