"""Version results compared pair by pair: summaries, noise bands, flags."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("dataset", "seed")
# Default noise band per metric, direction (True = larger is better), cost factor,
# largest tolerated extra drop from OOT to holdout.
DEFAULT_BANDS = {"holdout": 0.003, "delta_b1": 0.003, "wasted_rate": 0.1, "rejected_decisions": 1.0, "upgrade_hit_rate": 0.2, "fe_in_final": 0.5}
LARGER_IS_BETTER = {"holdout": True, "delta_b1": True, "wasted_rate": False, "rejected_decisions": False, "upgrade_hit_rate": True, "fe_in_final": True}
COST_UP = 1.3
OVERFIT_EXCESS = 0.02


@dataclass(frozen=True)
class Noise:
    """Noise bands; ``by_dataset`` is a table ``(dataset, metric, band)`` that overrides the defaults."""

    bands: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_BANDS))
    by_dataset: DataFrame | None = None


def version_summary(runs: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Per dataset: runs, mean holdout, mean gain over the baseline, worst run, totals.

    A failed run is worse than any finished one.
    """
    ok = (F.col("status") == "ok") & F.col("holdout").isNotNull()
    base = runs
    if baselines is not None:
        b1 = baselines.where(F.col("name") == "b1").select("dataset", F.col("holdout_auc").alias("_b1"))
        base = runs.join(b1, "dataset", "left")
    else:
        base = runs.withColumn("_b1", F.lit(None).cast("double"))
    rank = F.struct(ok.cast("int").alias("ok"), F.coalesce("holdout", F.lit(0.0)).alias("h"), F.col("seed"))
    return base.groupBy("dataset").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.col("holdout"))).alias("holdout_mean"),
        F.avg(F.when(ok, F.col("holdout") - F.col("_b1"))).alias("delta_b1_mean"), F.min_by("seed", rank).alias("worst_seed"),
        F.count_if(F.coalesce(F.col("fe_in_final") > 0, F.lit(False))).alias("n_fe_in_final"),
        F.sum(F.coalesce("wall_sec", F.lit(0.0))).alias("wall_sec"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"),
    )


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace rows by ``(dataset, seed)``, keep the rest."""
    return old.join(new.select(*KEY).distinct(), list(KEY), "left_anti").unionByName(new)


def with_gain(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add ``delta_b1`` from the baseline table."""
    b1 = baselines.where(F.col("name") == "b1").select("dataset", F.col("holdout_auc").alias("_b1"))
    return runs.join(b1, "dataset", "left").withColumn("delta_b1", F.col("holdout") - F.col("_b1")).drop("_b1")


def paired_metrics(new: DataFrame, old: DataFrame, metrics=tuple(DEFAULT_BANDS)) -> DataFrame:
    """``(dataset, seed, metric, x, y, d)`` for runs present in both versions."""
    present = [m for m in metrics if m in new.columns and m in old.columns]
    side = lambda df, v: df.select(*KEY, *[F.col(m).cast("double").alias(m) for m in present]).unpivot(list(KEY), present, "metric", v).where(F.col(v).isNotNull())
    return side(new, "x").join(side(old, "y"), [*KEY, "metric"]).withColumn("d", F.col("x") - F.col("y"))


def _band(noise: Noise) -> Column:
    out = F.lit(None).cast("double")
    for m, v in noise.bands.items():
        out = F.when(F.col("metric") == m, F.lit(float(v))).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def regression_compare(new: DataFrame, old: DataFrame, noise: Noise = Noise()) -> DataFrame:
    """One row per dataset and metric with the mean paired difference and its verdict.

    A change must exceed the noise band and point the same way in all pairs (up to two) or in
    at least two thirds of them.
    """
    pairs = paired_metrics(new, old)
    mean = pairs.groupBy("dataset", "metric").agg(
        F.avg("d").alias("delta"), F.avg("x").alias("new"), F.avg("y").alias("old"), F.count("*").alias("n"),
        F.count_if(F.col("d") > 0).alias("_up"), F.count_if(F.col("d") < 0).alias("_down"),
        F.min_by("seed", F.struct("d", "seed")).alias("_low"), F.min_by("seed", F.struct(-F.col("d"), F.col("seed"))).alias("_high"),
    )
    banded = mean.withColumn("band", _band(noise))
    if noise.by_dataset is not None:
        own = noise.by_dataset.select("dataset", "metric", F.col("band").alias("_own"))
        banded = banded.join(own, ["dataset", "metric"], "left").withColumn("band", F.coalesce("_own", "band")).drop("_own")
    same = F.when(F.col("delta") > 0, F.col("_up")).when(F.col("delta") < 0, F.col("_down")).otherwise(0)
    needed = F.when(F.col("n") <= 2, F.col("n")).otherwise(F.ceil(2 * F.col("n") / 3.0))
    up = F.lit(False)
    for m, larger in LARGER_IS_BETTER.items():
        if larger:
            up = up | (F.col("metric") == m)
    moved = (F.abs("delta") > F.col("band")) & (same >= needed)
    result = F.when(~moved, "same").when((F.col("delta") > 0) == up, "better").otherwise("worse")
    return banded.select("dataset", "metric", "delta", "new", "old", "n", result.alias("verdict"), F.when(up, F.col("_low")).otherwise(F.col("_high")).alias("worst_seed"))


def cost_compare(new: DataFrame, old: DataFrame, keys=("wall_sec", "cost_usd"), limits: DataFrame | None = None) -> DataFrame:
    """Totals of wall time and cost over paired runs, their ratio and the threshold."""
    side = lambda df, v: df.select(*KEY, *[F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in keys]).unpivot(list(KEY), list(keys), "key", v)
    tot = side(new, "x").join(side(old, "y"), [*KEY, "key"]).groupBy("dataset", "key").agg(F.sum("x").alias("new"), F.sum("y").alias("old"))
    if limits is not None:
        tot = tot.join(limits.select("dataset", "key", F.col("ratio").alias("_limit")), ["dataset", "key"], "left")
    else:
        tot = tot.withColumn("_limit", F.lit(None).cast("double"))
    limit = F.coalesce("_limit", F.lit(COST_UP))
    return tot.select("dataset", "key", "new", "old", F.try_divide(F.col("new"), F.col("old")).alias("ratio"), limit.alias("threshold"), ((F.col("old") > 0) & (F.col("new") > limit * F.col("old"))).alias("flag"))


def _drift_excess(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    b0 = baselines.where(F.col("name") == "b0").select("dataset", (F.col("oot_dev_auc") - F.col("holdout_auc")).alias("_ref"))
    return runs.join(b0, "dataset", "left").withColumn("excess", F.col("oot_dev") - F.col("holdout") - F.coalesce("_ref", F.lit(0.0))).drop("_ref")


def hard_flags(new: DataFrame, old: DataFrame, new_base: DataFrame, old_base: DataFrame, new_kinds: DataFrame | None = None, old_kinds: DataFrame | None = None, new_scenarios: DataFrame | None = None, old_scenarios: DataFrame | None = None) -> DataFrame:
    """``(kind, dataset, seed, detail)`` for everything that is reported whatever the noise band."""
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "dataset", F.col("seed").cast("int").alias("seed"), detail.alias("detail"))
    failed = (F.coalesce(F.col("status"), F.lit("")) != "ok") | F.col("holdout").isNull()
    out = row(new.where(failed), "failed_run", F.lit("no final model"))
    if "decide_failed" in new.columns:
        out = out.unionByName(row(new.where(F.coalesce("decide_failed", F.lit(False))), "decide_failed", F.lit("ended by a failed decision")))
    over = _drift_excess(new, new_base).where(F.col("excess") > OVERFIT_EXCESS)
    before = _drift_excess(old, old_base).where(F.col("excess") > OVERFIT_EXCESS).select(*KEY)
    out = out.unionByName(row(over.join(before, list(KEY), "left_anti"), "overfit", F.lit("holdout drops more than the baseline's")))
    if new_kinds is not None and old_kinds is not None:
        both = new_kinds.join(old.select(*KEY), list(KEY), "left_semi")
        fresh = both.join(old_kinds, [*KEY, "reject_kind"], "left_anti")
        out = out.unionByName(row(fresh, "new_reject_kind", F.col("reject_kind")))
    if new_scenarios is not None and old_scenarios is not None:
        o = old_scenarios.select("scenario", "base", F.col("passed").alias("_was"))
        s = new_scenarios.where(~F.coalesce(F.col("passed"), F.lit(False))).join(o, ["scenario", "base"], "left")
        s = s.where(F.col("_was").isNull() | F.col("_was"))
        out = out.unionByName(s.select(F.when(F.col("_was").isNull(), "scenario_failed").otherwise("scenario_regressed").alias("kind"), F.col("base").alias("dataset"), F.lit(None).cast("int").alias("seed"), F.col("scenario").alias("detail")))
    costs = cost_compare(new, old).where("flag")
    return out.unionByName(costs.select(F.lit("cost_up").alias("kind"), "dataset", F.lit(None).cast("int").alias("seed"), F.col("key").alias("detail")))


def calibrate_noise(a: DataFrame, b: DataFrame, noise: Noise = Noise()) -> DataFrame:
    """Noise band per dataset and metric from two runs of the same code; never below the default."""
    out = paired_metrics(a, b).groupBy("dataset", "metric").agg(F.max(F.abs("d")).alias("_seen"), F.count("*").alias("n"))
    return out.select("dataset", "metric", "n", F.greatest(F.round("_seen", 4), _band(noise)).alias("band"))


def calibrate_cost(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cost thresholds per dataset: the larger ratio of the two totals, rounded up to cents, at least 1.3."""
    both = cost_compare(a, b)
    worst = F.greatest(F.lit(COST_UP), F.coalesce(F.try_divide(F.col("new"), F.col("old")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("old"), F.col("new")), F.lit(0.0)))
    return both.select("dataset", "key", (F.ceil(F.round(100 * worst, 9)) / 100).alias("ratio"))
