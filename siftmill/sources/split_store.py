"""Split tables on disk with an isolated holdout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.plans.sizing import once
from siftmill.columns import OPEN_SPLITS, SPLIT
from siftmill.sources.tables import path_exists


class HoldoutAccessError(PermissionError):
    """The holdout was asked for without a gate."""


class HoldoutUsedError(RuntimeError):
    """The holdout was already spent on another experiment."""


class SplitStore:
    """Open splits below ``<root>/splits``, the holdout below ``<root>/holdout``.

    A plain read of the splits can never include holdout rows: they live in another folder and
    need a :class:`FinalGate`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame) -> None:
        df = once(df, always=True)  # both parts are read from one computation
        df.where(F.col(SPLIT).isin(*OPEN_SPLITS)).write.mode("overwrite").partitionBy(SPLIT).parquet(f"{self.root}/splits")
        df.where(F.col(SPLIT) == "holdout").drop(SPLIT).write.mode("overwrite").parquet(f"{self.root}/holdout")

    def read(self, split: str, gate: FinalGate | None = None) -> DataFrame:
        if split == "holdout":
            if not isinstance(gate, FinalGate):
                raise HoldoutAccessError("the holdout is only read through a final gate")
            return self.spark.read.parquet(f"{self.root}/holdout")
        if split not in OPEN_SPLITS:
            raise ValueError(f"unknown split {split}")
        return self.spark.read.parquet(f"{self.root}/splits/{SPLIT}={split}")

    def read_open(self) -> DataFrame:
        """All open splits with their name; partition pruning keeps a filter on it cheap."""
        return self.spark.read.parquet(f"{self.root}/splits")


class FinalGate:
    """Scores the holdout once per task.

    The result is written with ``errorifexists``: a second experiment cannot get a result, and a
    replay of the same experiment gets the stored one without touching the holdout again.
    """

    def __init__(self, store: SplitStore, task_id: str):
        self.store, self.task_id = store, task_id
        self.path = f"{store.root}/final_gate/{task_id}"

    def stored(self, exp_id: str) -> DataFrame | None:
        if not path_exists(self.store.spark, f"{self.path}/_SUCCESS"):
            return None
        done = self.store.spark.read.parquet(self.path)
        if done.where(F.col("exp_id") == exp_id).isEmpty():
            raise HoldoutUsedError(f"holdout of {self.task_id} was used by another experiment")
        return done

    def run_once(self, exp_id: str, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``evaluate`` turns the holdout rows into a result table."""
        done = self.stored(exp_id)
        if done is not None:
            return done
        result = evaluate(self.store.read("holdout", self)).withColumn("exp_id", F.lit(exp_id))
        result.write.mode("errorifexists").parquet(self.path)
        return self.store.spark.read.parquet(self.path)
