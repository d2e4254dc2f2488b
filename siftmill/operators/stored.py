"""Fitted models kept on shared storage: fitted once, read wherever they are needed again.

The reference is the default boosted model of a task. It is fitted at the start, and the final
check reads the very same model, so its drift between the open and the final rows is comparable
with that of the candidates.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.columns import SPLIT
from siftmill.operators import compare, metrics
from siftmill.operators.encoding import Encoder, Inputs
from siftmill.operators.models import MODELS, Fitted, predictions, woe_transform
from siftmill.session import cut_lineage
from siftmill.sources.tables import path_exists

_CLASSES = {"gbt": GBTClassificationModel, "random_forest": RandomForestClassificationModel, "scorecard": LogisticRegressionModel}
_DONE = "complete"


def save(fitted: Fitted, folder: str) -> None:
    """Write a model with its inputs; the mark that it is complete comes last."""
    if fitted.name not in _CLASSES:
        raise ValueError(f"no stored form for {fitted.name}")
    spark, inputs = SparkSession.getActiveSession(), fitted.inputs
    fitted.model.write().overwrite().save(f"{folder}/model")
    meta = {"name": fitted.name, "inputs": [list(inputs.numeric), list(inputs.categorical), list(inputs.dates), inputs.date_pattern]}
    meta["info"] = {k: v for k, v in fitted.info.items() if isinstance(v, int | float | str | dict)}
    encoder = fitted.info.get("encoder")
    if encoder:
        meta["encoder"] = {"medians": encoder.medians, "sizes": encoder.sizes, "n": encoder.n, "prior": encoder.prior, "max_codes": encoder.max_codes}
    table = encoder.levels if encoder else fitted.info["woe"]
    if table is not None:
        table.write.mode("overwrite").parquet(f"{folder}/table")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{_DONE}")


def load(spark: SparkSession, folder: str) -> Fitted:
    """The model as it was written."""
    meta = json.loads(spark.read.parquet(f"{folder}/{_DONE}").first()["meta"])
    numeric, categorical, dates, pattern = meta["inputs"]
    inputs = Inputs(tuple(numeric), tuple(categorical), tuple(dates), pattern)
    model = _CLASSES[meta["name"]].load(f"{folder}/model")
    table = spark.read.parquet(f"{folder}/table") if path_exists(spark, f"{folder}/table") else None
    if "encoder" in meta:
        encoder = Encoder(inputs, levels=table, **meta["encoder"])
        return Fitted(meta["name"], inputs, encoder.transform, model, {**meta["info"], "encoder": encoder})
    assembler = VectorAssembler(inputCols=[f"{c}__woe" for c in inputs.names], outputCol="features")
    transform = lambda df: woe_transform(df, inputs, table)
    return Fitted(meta["name"], inputs, lambda df: assembler.transform(transform(df)), model, {**meta["info"], "woe": table, "woe_transform": transform})


def reference_model(splits: DataFrame, inputs: Inputs, folder: str, params: Mapping | None = None, seed: int = 0) -> Fitted:
    """The task's default model: fitted on the first call, read from ``folder`` by later ones."""
    spark = splits.sparkSession
    if not path_exists(spark, f"{folder}/{_DONE}"):
        train, valid = splits.where(F.col(SPLIT) == "train"), splits.where(F.col(SPLIT) == "valid")
        save(MODELS["gbt"](train, valid, inputs, dict(params or {}), seed), folder)
    return load(spark, folder)


def reference_gap(fitted: Fitted, splits: DataFrame, primary: str = "auc") -> DataFrame:
    """One row: ``valid``, ``oot_dev``, ``gap`` and the power of the OOT rows to show a difference."""
    preds = cut_lineage(predictions(fitted, splits.where(F.col(SPLIT).isin("valid", "oot_dev")), "reference"))
    rows = metrics.METRICS[primary][0](preds, ["exp_id", SPLIT])
    side = lambda s: F.max(F.when(F.col(SPLIT) == s, F.col(primary)))
    out = rows.groupBy("exp_id").agg(side("valid").alias("valid"), side("oot_dev").alias("oot_dev")).withColumn("gap", F.col("valid") - F.col("oot_dev"))
    power = metrics.oot_power(preds.where(F.col(SPLIT) == "oot_dev"), ["exp_id"])
    return out.join(F.broadcast(power), "exp_id", "left")  # one row


def reference_drop(fitted: Fitted, oot: DataFrame, holdout: DataFrame, primary: str = "auc") -> float:
    """How much the reference loses from the OOT rows to the holdout: this data's normal drift.
    0 where the metric is not defined on either side."""
    score = metrics.METRICS[primary][0]
    both = [score(predictions(fitted, rows.withColumn(SPLIT, F.lit(name)), name), ["exp_id"]).first() for name, rows in (("oot_dev", oot), ("holdout", holdout))]
    if any(r is None or r[primary] is None for r in both):
        return 0.0
    return float(both[0][primary] - both[1][primary])


def against_reference(fitted: Fitted, splits: DataFrame, preds: DataFrame, candidates: Sequence[str], alpha: float = 0.05, n: int = 1000, seed: int = 0) -> DataFrame:
    """One row per candidate: its paired difference to the reference on the OOT rows, with bounds."""
    oot = splits.where(F.col(SPLIT) == "oot_dev")
    base = cut_lineage(predictions(fitted, oot, "_reference"))
    mine = preds.where((F.col(SPLIT) == "oot_dev") & F.col("exp_id").isin(*candidates))
    both = mine.unionByName(base.select(mine.columns))
    out = None
    for name in candidates:
        row = compare.paired_bootstrap(compare.pair_predictions(both, name, "_reference"), alpha, n, seed).withColumn("exp_id", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("exp_id", "delta", "ci_low", "ci_high", "alpha", "significant")


def experiment_record(exp_id: str, fitted: Fitted, preds: DataFrame, fidelity: str = "full", monotone: bool = False) -> DataFrame:
    """One row about an experiment, as the judgement reads it: model, fidelity, ``n_features``,
    ``n_rows`` (training rows), ``best_iter`` and ``max_iter`` of boosted trees, and the metrics
    with the split as prefix, ``gap`` and ``score_psi``."""
    encoder = fitted.info.get("encoder")
    n_rows = encoder.n if encoder else fitted.info.get("n")
    of = preds.where(F.col("exp_id") == exp_id)
    long = metrics.all_metrics(of)
    names = [c for c in ("auc", "pr_auc", "ks") if c in long.columns]
    wide = long.groupBy("exp_id").agg(*[F.max(F.when(F.col(SPLIT) == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "valid", "oot_dev") for c in names])
    shift = metrics.population_shift(of.where(F.col(SPLIT).isin("valid", "oot_dev")), F.col(SPLIT) == "valid", ["exp_id"]).withColumnRenamed("psi", "score_psi")
    facts = {"model": fitted.name, "fidelity": fidelity, "monotone": monotone, "n_features": len(fitted.inputs.names), "n_rows": n_rows, "best_iter": fitted.info.get("best_iter"), "max_iter": fitted.info.get("max_iter")}
    kinds = {"model": "string", "fidelity": "string", "monotone": "boolean"}
    out = wide.join(F.broadcast(shift), "exp_id", "left")  # one row each
    return out.withColumns({c: F.lit(v).cast(kinds.get(c, "long")) for c, v in facts.items()}).withColumn("gap", F.col("valid_auc") - F.col("oot_dev_auc"))


__all__ = ["against_reference", "experiment_record", "load", "reference_drop", "reference_gap", "reference_model", "save"]
