"""Paired comparison of two scores on the same rows: bootstrap and DeLong.

``paired_bootstrap`` reweights rows: every row has its own Poisson weight in every replicate, a
hash of seed, replicate and row id, and a replicate needs four weighted sums. These are combined
on the map side, so the cost is one pass, whatever the number of different scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.metrics import METRICS, cumulative
from siftmill.plans.distribution import quantile_edges
from siftmill.plans.ordered import plan_buckets, running_totals
from siftmill.plans.skew import hot_split_join
from siftmill.session import cut_lineage

SIDES = ("new", "base")


def pair_predictions(preds: DataFrame, new: str, base: str, key: str = "_row_id") -> DataFrame:
    """``(key, y, p_new, p_base)`` of two experiments, matched on the row id, never on position."""
    left = preds.where(F.col("exp_id") == new).select(key, "y", F.col("p").alias("p_new"))
    right = preds.where(F.col("exp_id") == base).select(key, F.col("p").alias("p_base"))
    return left.join(right, key)


def _score_cuts(pairs: DataFrame, column: str, bins: int, buckets: int | None) -> list[float]:
    """Interior quantile edges of a score: at most ``bins - 1`` numbers."""
    dist = pairs.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    row = quantile_edges(dist, [], bins, plan_buckets(pairs, column, buckets)).first()
    return sorted(set(row["edges"][1:-1])) if row else []


def joint_cells(pairs: DataFrame, bins: int = 1000, buckets: int | None = None) -> DataFrame:
    """``(bin_new, bin_base, y) -> n``: all the data a paired resample needs.

    Scores are cut into at most ``bins`` quantile bins (an approximation when there are more
    distinct scores), so the table is bounded by ``2 * bins**2`` rows at any input size.
    """
    out = pairs.where("y is not null and p_new is not null and p_base is not null")
    for side in SIDES:
        splits = [float("-inf"), *_score_cuts(out, f"p_{side}", bins, buckets), float("inf")]
        if len(splits) < 3:
            out = out.withColumn(f"bin_{side}", F.lit(0))
            continue
        cut = Bucketizer(splits=splits, inputCol=f"_s_{side}", outputCol=f"_b_{side}")
        out = cut.transform(out.withColumn(f"_s_{side}", F.col(f"p_{side}").cast("double"))).withColumn(f"bin_{side}", F.col(f"_b_{side}").cast("int"))
    return out.groupBy("bin_new", "bin_base", F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"))


def histogram_metric(metric: str, pos: np.ndarray, neg: np.ndarray) -> float:
    """Metric from weighted counts per score bin, lowest score first."""
    n_pos, n_neg = pos.sum(), neg.sum()
    if not n_pos or not n_neg:
        return float("nan")
    below = np.cumsum(neg) - neg
    if metric == "auc":
        return float((pos * (below + neg / 2)).sum() / (n_pos * n_neg))
    if metric == "ks":
        return float(np.abs(np.cumsum(pos) / n_pos - np.cumsum(neg) / n_neg).max())
    top_pos, top_neg = np.cumsum(pos[::-1])[::-1], np.cumsum(neg[::-1])[::-1]
    filled = top_pos + top_neg > 0
    return float((pos[filled] * top_pos[filled] / (top_pos + top_neg)[filled]).sum() / n_pos)


def _replicates(cells, metric: str, seed: int):
    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Poisson resamples of the cell counts; a replicate's generator depends on its number only."""
        c = cells.value
        is_pos, sizes = c["y"] == 1, (int(c["bin_new"].max()) + 1, int(c["bin_base"].max()) + 1)
        for frame in frames:
            deltas = []
            for rep in frame["id"]:
                w = np.random.default_rng([seed, int(rep)]).poisson(c["n"])
                values = []
                for side, size in zip(("bin_new", "bin_base"), sizes):
                    hist = lambda m: np.bincount(c[side][m], weights=w[m], minlength=size)
                    values.append(histogram_metric(metric, hist(is_pos), hist(~is_pos)))
                deltas.append(values[0] - values[1])
            yield pd.DataFrame({"rep": frame["id"], "d": deltas})

    return draw


def approximate_bootstrap(pairs: DataFrame, alpha: float = 0.05, n: int = 1000, seed: int = 0, metric: str = "auc", bins: int = 1000, buckets: int | None = None) -> DataFrame:
    """Like ``paired_bootstrap`` for any metric, on scores cut into ``bins`` quantile bins: the
    difference is exact, its bounds are those of the binned scores.

    The rows are read once and reduced to the joint cells, whose number is bounded by ``bins``;
    the cells are sent to every task and the replicates run side by side.
    """
    spark = pairs.sparkSession
    rows = joint_cells(pairs, bins, buckets).toPandas()
    cells = spark.sparkContext.broadcast({c: rows[c].to_numpy(dtype=np.int64) for c in ("bin_new", "bin_base", "y", "n")})
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism))
    drawn = spark.range(0, n, 1, tasks).mapInPandas(_replicates(cells, metric, seed), "rep long, d double")
    bounds = drawn.agg(F.percentile("d", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("q"))  # n numbers
    long = pairs.unpivot(["y"], ["p_new", "p_base"], "side", "p")
    point = METRICS[metric][0](long, ["side"], buckets=buckets)
    exact = point.agg((F.max(F.when(F.col("side") == "p_new", F.col(metric))) - F.max(F.when(F.col("side") == "p_base", F.col(metric)))).alias("delta"))
    return exact.join(F.broadcast(bounds)).select(  # one row each
        "delta", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.lit(alpha).alias("alpha"), (F.col("q")[0] > 0).alias("significant")
    )


def _placements(pairs: DataFrame, side: str, key: str, buckets: int | None) -> DataFrame:
    """Placement value of every row under one score."""
    counts = pairs.groupBy(F.col(f"p_{side}").alias("s")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    cum = running_totals(counts, [], ["s"], {"cpos": F.col("pos"), "cneg": F.col("neg")}, plan_buckets(pairs, f"p_{side}", buckets), grand={"pos_all": F.col("pos"), "neg_all": F.col("neg")})
    place = cum.select(
        F.col("s").alias(f"p_{side}"), F.try_divide(F.col("cneg") - F.col("neg") / 2.0, F.col("neg_all")).alias(f"v_{side}_pos"),
        (1 - F.try_divide(F.col("cpos") - F.col("pos") / 2.0, F.col("pos_all"))).alias(f"v_{side}_neg"), ((F.col("pos") + F.col("neg")) > 0.001 * (F.col("pos_all") + F.col("neg_all"))).alias("_often"),
    )
    return hot_split_join(pairs, place, [f"p_{side}"], F.col("_often"), 1000, key).drop("_often")


# ---- multiplier bootstrap --------------------------------------------------------------------

LANES = 4  # weights taken from one digest, eight hex digits each


def poisson_limits() -> list[str]:
    """Eight hex digits below which a uniform draw has a Poisson weight of 0, 1, 2 ..."""
    sums = [exp(-1) * sum(1 / factorial(j) for j in range(k + 1)) for k in range(12)]
    return [f"{int(s * 2**32):08x}" for s in sums]


def poisson_weight(digest: Column, lane: int) -> Column:
    """Poisson weight with mean 1 from eight hex digits, which order like the numbers they stand for."""
    drawn, out = F.substring(digest, 8 * lane + 1, 8), None
    for k, limit in enumerate(poisson_limits()):
        out = (F if out is None else out).when(drawn < limit, float(k))
    return out.otherwise(12.0)


def _shares(pairs: DataFrame, metric: str, key: str, buckets: int | None) -> tuple[DataFrame, bool]:
    """``key``, ``y``, ``d``: what a row adds to the difference of the metric as a mean over its
    class. Both classes' means are the AUC difference; for KS they add up to the difference."""
    if metric == "auc":
        placed = _placements(_placements(pairs, "new", key, buckets), "base", key, buckets)
        d = F.when(F.col("y") == 1, F.col("v_new_pos") - F.col("v_base_pos")).otherwise(F.col("v_new_neg") - F.col("v_base_neg"))
        return placed.select(key, "y", d.alias("d")), True
    if metric != "ks":
        raise ValueError(f"no row shares for {metric}: use approximate_bootstrap")
    d = F.lit(0.0)
    for side, sign in (("new", 1.0), ("base", -1.0)):
        # The score of the largest distance stays where it is: the first-order share of a row.
        cum = cumulative(pairs, [], "y", f"p_{side}", buckets, None)
        apart = F.try_divide(F.col("cneg").cast("double"), F.col("neg_all")) - F.try_divide(F.col("cpos").cast("double"), F.col("pos_all"))
        top = cum.agg(F.max(F.struct(F.abs(apart).alias("gap"), (-F.col("p")).alias("at"), apart.alias("apart"))).alias("t")).first()["t"]
        if top is None or top["gap"] is None:
            return pairs.select(key, "y", F.lit(None).cast("double").alias("d")), False
        below = (F.col(f"p_{side}").cast("double") <= F.lit(-top["at"])).cast("double") * (sign if top["apart"] >= 0 else -sign)
        d = d + F.when(F.col("y") == 1, -below).otherwise(below)
    return pairs.select(key, "y", d.alias("d")), False


def replicate_deltas(shares: DataFrame, both: bool, n: int, seed: int, key: str) -> DataFrame:
    """``rep``, ``d``: the difference in every replicate, null where a class has no weight."""
    ids = F.sequence(F.lit(0), F.lit(-(-n // LANES) - 1))
    rows = shares.select(F.col(key).cast("string").alias("_id"), (F.col("y") == 1).alias("_pos"), "d", F.explode(ids).alias("block"))
    rows = rows.withColumn("_md5", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"), F.col("_id"))))
    rows = rows.withColumns({f"w{i}": poisson_weight(F.col("_md5"), i) for i in range(LANES)})
    sums = []
    for i in range(LANES):
        w = F.col(f"w{i}")
        for side, mark in (("p", F.col("_pos")), ("n", ~F.col("_pos"))):
            sums += [F.sum(F.when(mark, w)).alias(f"{side}w{i}"), F.sum(F.when(mark, w * F.col("d"))).alias(f"{side}d{i}")]
    per = rows.groupBy("block").agg(*sums)  # combined before the shuffle: n / LANES rows a task
    mean = lambda side, i: F.try_divide(F.col(f"{side}d{i}"), F.col(f"{side}w{i}"))
    lanes = [F.struct((F.col("block") * LANES + i).alias("rep"), (mean("p", i) + mean("n", i)).alias("d")) for i in range(LANES)]
    out = per.select(F.explode(F.array(*lanes)).alias("x")).select("x.*").where(F.col("rep") < n)
    if both:  # each class's mean is the whole difference, so it was counted twice
        whole = shares.agg((F.avg(F.when(F.col("y") == 1, F.col("d")))).alias("_delta"))
        out = out.join(F.broadcast(whole)).select("rep", (F.col("d") - F.col("_delta")).alias("d"))  # one row
    return out


def paired_bootstrap(pairs: DataFrame, alpha: float = 0.05, n: int = 1000, seed: int = 0, metric: str = "auc", key: str = "_row_id", buckets: int | None = None) -> DataFrame:
    """Difference of a metric with one-sided bootstrap bounds; significant when the lower one is above 0.

    A multiplier bootstrap over rows: a replicate is the weighted mean of the rows' placement
    values, the first-order form of the metric on a resample. Weights depend on ``seed``, the
    replicate and the row id only, so order and layout of the rows do not matter. For ``auc`` and
    ``ks``. Rows without label or score are left out; without both classes all numbers are null.
    """
    ok = pairs.where("y is not null and p_new is not null and p_base is not null")
    shares, both = _shares(ok, metric, key, buckets)
    shares = cut_lineage(shares)
    bounds = replicate_deltas(shares, both, n, seed, key).agg(F.percentile("d", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("q"))  # n numbers
    mean = lambda mark: F.avg(F.when(mark, F.col("d")))
    delta = mean(F.col("y") == 1) if both else mean(F.col("y") == 1) + mean(F.col("y") != 1)
    point = shares.agg(delta.alias("delta"), F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") != 1).alias("_n"))
    point = point.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("delta")).alias("delta"))
    return point.join(F.broadcast(bounds)).select(  # one row each
        "delta", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.lit(alpha).alias("alpha"), (F.col("q")[0] > 0).alias("significant")
    )


def delong_paired(pairs: DataFrame, alpha: float = 0.05, key: str = "_row_id", buckets: int | None = None) -> DataFrame:
    """AUC difference with its DeLong standard error: the deterministic alternative to resampling."""
    ok = pairs.where("y is not null and p_new is not null and p_base is not null")
    rows = _placements(_placements(ok, "new", key, buckets), "base", key, buckets)
    pos, neg = F.col("y") == 1, F.col("y") != 1
    diff_pos, diff_neg = F.col("v_new_pos") - F.col("v_base_pos"), F.col("v_new_neg") - F.col("v_base_neg")
    s = rows.agg(
        F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"),
        F.avg(F.when(pos, F.col("v_new_pos"))).alias("auc_new"), F.avg(F.when(pos, F.col("v_base_pos"))).alias("auc_base"),
        F.var_samp(F.when(pos, diff_pos)).alias("_vp"), F.var_samp(F.when(neg, diff_neg)).alias("_vn"),
    )
    se = F.sqrt(F.col("_vp") / F.col("n_pos") + F.col("_vn") / F.col("n_neg"))
    z = NormalDist().inv_cdf(1 - alpha)
    delta = F.col("auc_new") - F.col("auc_base")
    return s.select("n_pos", "n_neg", "auc_new", "auc_base", delta.alias("delta"), se.alias("se"), (delta - z * se).alias("ci_low"), (delta + z * se).alias("ci_high"), (delta - z * se > 0).alias("significant"))

