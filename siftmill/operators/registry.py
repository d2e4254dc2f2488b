"""Registered feature sets: parquet per set and split, definitions next to them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.columns import ID, SPLIT
from siftmill.operators.factory import attach

DEFS = "name string, expr string, window string, prior int, template string, rationale string, source string, kept boolean"


class FeatureStore:
    """Feature sets below one root folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def register(self, fs_id: str, features: DataFrame, definitions: Sequence[dict], kept: Sequence[str]) -> None:
        """Write the features (one folder per split when the split is given) and their lineage."""
        writer = features.write.mode("overwrite")
        (writer.partitionBy(SPLIT) if SPLIT in features.columns else writer).parquet(f"{self.root}/features/{fs_id}")
        rows = [(d["name"], d["expr"], d["window"], d["prior"], d["template"], d.get("rationale", ""), d["source"], d["name"] in kept) for d in definitions]
        self.spark.createDataFrame(rows, DEFS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/defs/{fs_id}")

    def definitions(self, fs_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/defs/{fs_id}").withColumn("fs_id", F.lit(fs_id))

    def kept(self, fs_id: str) -> list[str]:
        return [r["name"] for r in self.definitions(fs_id).where("kept").orderBy("name").collect()]

    def features(self, fs_id: str, split: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/features/{fs_id}")
        return df if split is None else df.where(F.col(SPLIT) == split).drop(SPLIT)

    def attach(self, df: DataFrame, fs_ids: Sequence[str], split: str | None = None) -> DataFrame:
        """Left join the kept columns of each set on the row id."""
        for fs_id in fs_ids:
            df = attach(df, self.features(fs_id, split), self.kept(fs_id))
        return df


def definition_json(definitions: Sequence[dict]) -> str:
    return json.dumps(list(definitions), sort_keys=True)


def check_unique_ids(features: DataFrame) -> DataFrame:
    """Row ids that occur more than once; a feature set with any of them would multiply rows."""
    return features.groupBy(ID).count().where("count > 1")
