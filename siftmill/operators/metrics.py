"""Ranking metrics, exact and distributed.

Every metric starts from ``(group, score) -> (positives, negatives)``: tied scores are one row,
so ties need no special care and one very frequent score costs one row per input partition.
Running counts along the score (see ``plans.ordered``) replace a global sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.dates import month_of
from siftmill.plans.distribution import left_closed_bin, quantile_edges
from siftmill.plans.ordered import plan_buckets, running_totals
from siftmill.plans.sizing import settle

Y, P = "y", "p"


def score_counts(df: DataFrame, by: Sequence[str], y: str = Y, p: str = P) -> DataFrame:
    """``(by, p) -> pos, neg``; rows without label or score are ignored, NaN counts as missing."""
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
    return ok.groupBy(*by, F.col(p).cast("double").alias(P)).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def cumulative(df: DataFrame, by: Sequence[str], y: str, p: str, buckets: int | None, bounds: Sequence[float] | None) -> DataFrame:
    cuts = plan_buckets(df.select(F.col(p).cast("double").alias(P)), P, buckets) if bounds is None else bounds
    return running_totals(
        score_counts(df, by, y, p), by, [P], {"cpos": F.col("pos"), "cneg": F.col("neg")}, cuts,
        grand={"pos_all": F.col("pos"), "neg_all": F.col("neg")},
    )


def _u_statistic() -> Column:
    """Pairs (positive above negative) plus half the ties, per distinct score."""
    below = F.col("cneg") - F.col("neg")
    return F.sum(F.col("pos") * (below + F.col("neg") / 2.0))


def auc(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P, buckets: int | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """Midrank AUC per group with class counts; NULL when a class is missing."""
    cum = cumulative(df, by, y, p, buckets, bounds)
    agg = cum.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), _u_statistic().alias("_u"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return agg.withColumn("auc", F.try_divide(F.col("_u"), pairs)).drop("_u")


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P, buckets: int | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """AUC, average precision and KS of every group from one set of running counts."""
    rows = cumulative(df, by, y, p, buckets, bounds)
    # Seen from the top: everything at or above this score.
    above_pos = F.col("pos_all") - F.col("cpos") + F.col("pos")
    above_all = above_pos + F.col("neg_all") - F.col("cneg") + F.col("neg")
    precision = F.try_divide(above_pos.cast("double"), above_all)
    gap = F.abs(F.try_divide(F.col("cpos").cast("double"), F.col("pos_all")) - F.try_divide(F.col("cneg").cast("double"), F.col("neg_all")))
    agg = rows.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), _u_statistic().alias("_u"),
        F.sum(F.col("pos") * precision).alias("_ap"), F.max(gap).alias("ks"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return agg.select(
        *by, "n_pos", "n_neg", F.try_divide(F.col("_u"), pairs).alias("auc"),
        F.try_divide(F.col("_ap"), F.col("n_pos")).alias("pr_auc"), "ks",
    )


def average_precision(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P, buckets: int | None = None) -> DataFrame:
    return ranking_metrics(df, by, y, p, buckets).select(*by, "n_pos", "n_neg", "pr_auc")


def ks(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P, buckets: int | None = None) -> DataFrame:
    return ranking_metrics(df, by, y, p, buckets).select(*by, "n_pos", "n_neg", "ks")


# Pluggable metric table: name -> function, largest tolerated valid-minus-OOT gap.
METRICS: dict[str, tuple[Callable[..., DataFrame], float]] = {"auc": (auc, 0.03), "pr_auc": (average_precision, 0.05), "ks": (ks, 0.05)}


def register_metric(name: str, function: Callable[..., DataFrame], gap_max: float) -> None:
    """Add a metric; larger must be better."""
    METRICS[name] = (function, gap_max)


def brier(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count(F.col(p)).alias("n"))


def top_decile(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P, key: str = "_row_id", buckets: int | None = None, share: float = 0.1) -> DataFrame:
    """Lift and recall of the top tenth by score; ties at the cut are broken by row id.

    Running counts find the score at which the cut falls; only rows with exactly that score are
    ordered by id. When that score is very frequent the ids are cut into buckets as well.
    """
    cuts = plan_buckets(df.select(F.col(p).cast("double").alias(P)), P, buckets)
    both = F.col("pos") + F.col("neg")
    rows = running_totals(score_counts(df, by, y, p), by, [P], {"_up": both}, cuts, grand={"n": both, "pos_all": F.col("pos")})
    rows = rows.withColumn("k", F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("long")))
    above, m = F.col("n") - F.col("_up"), both
    cut_here = (above < F.col("k")) & (above + m > F.col("k"))
    tops = rows.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("pos_all").alias("pos_all"), F.max("k").alias("k"),
        F.sum(F.when(above + m <= F.col("k"), F.col("pos")).otherwise(0)).alias("full_pos"),
        F.max(F.when(cut_here, F.col(P))).alias("_edge"), F.max(F.when(cut_here, F.col("k") - above)).alias("_need"),
    )
    tops = settle(tops, df)
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("_edge", F.col(p).cast("double"))
    tied = ok.join(tops.select(*by, "_edge", "_need"), [*by, "_edge"]).select(*by, "_need", F.col(key).alias("_key"), F.col(y).alias(Y))
    ranked = running_totals(tied, by, ["_key"], {"_rank": F.lit(1).cast("long")}, plan_buckets(df.select(F.col(key).alias("_key")), "_key", buckets))
    part = ranked.where(F.col("_rank") <= F.col("_need")).groupBy(*by).agg(F.sum((F.col(Y) == 1).cast("long")).alias("part_pos"))
    out = tops.join(part, list(by), "left") if by else tops.join(F.broadcast(part))
    hit = F.col("full_pos") + F.coalesce("part_pos", F.lit(0))
    base = F.try_divide(F.col("pos_all").cast("double"), F.col("n"))
    return out.select(
        *by, "n", F.col("k").alias("n_top"), hit.alias("top_pos"),
        F.try_divide(F.try_divide(hit.cast("double"), F.col("k")), base).alias("lift_top10"),
        F.try_divide(hit.cast("double"), F.col("pos_all")).alias("recall_top10"),
    )


def monthly_auc(df: DataFrame, time_col: str, by: Sequence[str] = (), min_n: int = 200, y: str = Y, p: str = P, buckets: int | None = None) -> DataFrame:
    """AUC, rows and positive rate per month; months that are too small or have one class are left out."""
    out = auc(df.withColumn("month", month_of(time_col)), [*by, "month"], y, p, buckets)
    n = F.col("n_pos") + F.col("n_neg")
    return out.where((n >= min_n) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        *by, "month", "auc", n.alias("n"), (F.col("n_pos").cast("double") / n).alias("bad_rate")
    )


def monthly_spread(monthly: DataFrame, by: Sequence[str] = (), limit: float = 0.05) -> DataFrame:
    """Spread of the monthly AUCs; a spread above ``limit`` is a stability risk."""
    out = monthly.groupBy(*by).agg(F.max("auc").alias("auc_max"), F.min("auc").alias("auc_min"), F.count("*").alias("n_months"))
    return out.withColumns({"spread": F.col("auc_max") - F.col("auc_min"), "risk": (F.col("auc_max") - F.col("auc_min")) > limit})


def yoy_bad_rate(df: DataFrame, time_col: str, y: str = Y) -> DataFrame:
    """Positive rate per month next to the rate of the same month a year earlier."""
    rate = df.groupBy(month_of(time_col).alias("month")).agg(F.avg(F.col(y).cast("double")).alias("bad_rate"))
    year = F.lpad((F.substring("month", 1, 4).cast("int") + 1).cast("string"), 4, "0")
    earlier = rate.select(F.concat(year, F.substring("month", 5, 3)).alias("month"), F.col("bad_rate").alias("bad_rate_last_year"))
    return rate.join(earlier, "month", "left")


def _placement_variance(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Variances of the placement values from collapsed counts.

    A positive with score s is placed above ``(neg below + neg tied / 2) / N`` of the negatives,
    a negative below the matching share of the positives; both are constant within a score.
    """
    v10 = (F.col("cneg") - F.col("neg") / 2.0) / F.col("neg_all")
    v01 = 1 - (F.col("cpos") - F.col("pos") / 2.0) / F.col("pos_all")
    spread = lambda w, v, n: (F.sum(w * v * v) - F.pow(F.sum(w * v), 2) / n) / (n - 1)
    return rows.groupBy(*by).agg(
        F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"),
        F.sqrt(spread(F.col("pos"), v10, F.max("pos_all")) / F.max("pos_all") + spread(F.col("neg"), v01, F.max("neg_all")) / F.max("neg_all")).alias("auc_se"),
    )


def auc_standard_error(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P, buckets: int | None = None) -> DataFrame:
    """DeLong standard error of the AUC per group."""
    rows = cumulative(df, by, y, p, buckets, None).where((F.col("pos_all") > 1) & (F.col("neg_all") > 1))
    return _placement_variance(rows, by)


def mde_factor(alpha: float = 0.05, power: float = 0.8, auc_corr: float = 0.82) -> float:
    """Smallest detectable AUC difference in units of the standard error."""
    z = NormalDist().inv_cdf
    return (z(1 - alpha) + z(power)) * (2 * (1 - auc_corr)) ** 0.5


def oot_power(df: DataFrame, by: Sequence[str] = (), alpha: float = 0.05, power: float = 0.8, auc_corr: float = 0.82, target: float = 0.01, y: str = Y, p: str = P, buckets: int | None = None) -> DataFrame:
    """Detectable improvement per group, whether it misses the target, and the positives needed."""
    se = auc_standard_error(df, by, y, p, buckets)
    mde = F.col("auc_se") * mde_factor(alpha, power, auc_corr)
    low = mde > target
    return se.select(
        *by, (F.col("n_pos") + F.col("n_neg")).alias("n_oot"), "n_pos", "auc_se", mde.alias("mde"), low.alias("underpowered"),
        F.when(low, F.ceil(F.col("n_pos") * F.pow(mde / target, 2))).alias("n_pos_needed"),
    )


def population_shift(df: DataFrame, reference: Column, by: Sequence[str] = (), p: str = P, bins: int = 10, actual_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """PSI of a score between reference rows and all other rows.

    Quantile edges come from the reference rows of each ``by`` group; the other rows are compared
    per ``by`` and ``actual_by`` group (for example per month). Bins are ``[a, b)`` with open ends.
    """
    vals = df.select(*dict.fromkeys([*by, *actual_by]), reference.alias("_ref"), F.col(p).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    by = list(by)
    ref_dist = vals.where("_ref").groupBy(*by, "value").agg(F.count("*").alias("n"))
    bounds = plan_buckets(vals, "value", buckets)
    edges = quantile_edges(ref_dist, by, bins, bounds)
    dist = vals.groupBy(*dict.fromkeys([*by, *actual_by]), "_ref", "value").agg(F.count("*").alias("n"))
    return shift_from_counts(dist, settle(edges, df), by, list(actual_by), bins)


def shift_from_counts(dist: DataFrame, edges: DataFrame, by: list[str], actual_by: list[str], bins: int) -> DataFrame:
    """PSI from ``(by, actual_by, _ref, value, n)`` and the edges of each ``by`` group.

    Every group is reduced to at most ``bins`` counts per side; a bin without rows counts as a
    share of 1e-6, and one that is empty on both sides adds nothing. Groups with fewer than three
    edges have PSI 0, groups without compared rows are left out.
    """
    joined = dist.join(edges, by, "left") if by else dist.join(F.broadcast(edges))  # one row
    placed = joined.select(*by, *actual_by, "_ref", "n", F.size("edges").alias("_k"), left_closed_bin(F.col("edges"), F.col("value")).alias("bin"))
    share = lambda part, whole: F.greatest(F.coalesce(part / whole, F.lit(0.0)), F.lit(1e-6))
    if not actual_by:
        side = lambda ref: F.sum(F.when(F.col("_ref") == ref, F.col("n")).otherwise(0))
        cells = placed.groupBy(*by, "bin").agg(side(True).alias("e"), side(False).alias("a"), F.max("_k").alias("_k"))
        size = Window.partitionBy(*by)  # at most `bins` rows per group
        cells = cells.withColumns({"_e": F.sum("e").over(size), "_a": F.sum("a").over(size)}).where((F.col("_a") > 0) & (F.col("_e") > 0))
        pe, pa = share(F.col("e"), F.col("_e")), share(F.col("a"), F.col("_a"))
        term = F.when(F.col("_k") < 3, F.lit(0.0)).otherwise((pa - pe) * F.ln(pa / pe))
        return cells.groupBy(*by).agg(F.sum(term).alias("psi"))
    counts = lambda rows, keys, name: rows.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.max("_k").alias("_k")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("n").cast("double")))).alias(name), F.sum("n").alias(f"_{name}"), F.max("_k").alias(f"_k_{name}")
    )
    ref, act = counts(placed.where("_ref"), by, "e"), counts(placed.where(~F.col("_ref")), [*by, *actual_by], "a")
    pair = act.join(ref, by) if by else act.join(F.broadcast(ref))  # one row
    number = F.sequence(F.lit(0), F.lit(bins - 1))

    def term(i):
        pe, pa = share(F.try_element_at("e", i), F.col("_e")), share(F.try_element_at("a", i), F.col("_a"))
        return (pa - pe) * F.ln(pa / pe)

    psi = F.aggregate(number, F.lit(0.0), lambda acc, i: acc + term(i))
    return pair.select(*by, *actual_by, F.when(F.col("_k_e") < 3, F.lit(0.0)).otherwise(psi).alias("psi"))


def psi_severity(psi: Column, warn: float = 0.10, severe: float = 0.25) -> Column:
    return F.when(psi > severe, "severe").when(psi > warn, "warn")


def all_metrics(df: DataFrame, exp: str = "exp_id", split: str = "split", primary: str = "auc", y: str = Y, p: str = P, buckets: int | None = None) -> DataFrame:
    """AUC, average precision and KS per experiment and split, plus the valid-minus-OOT gap."""
    out = ranking_metrics(df, [exp, split], y, p, buckets)
    side = lambda s: F.max(F.when(F.col(split) == s, F.col(primary))).over(Window.partitionBy(exp))
    return out.withColumn("gap", side("valid") - side("oot_dev"))


def midranks(df: DataFrame, by: Sequence[str], value: str, buckets: int | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """``(by, value) -> n, midrank``: average rank of tied values, one row per distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    cuts = plan_buckets(df, value, buckets) if bounds is None else bounds
    cum = running_totals(counts, by, [value], {"_cum": F.col("n")}, cuts)
    return cum.withColumn("midrank", F.col("_cum") - (F.col("n") - 1) / 2.0).drop("_cum")


def spearman_with_label(dist: DataFrame, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Spearman correlation of each feature with a 0/1 label from ``(by, value, n, n_pos)``.

    A binary label has two midranks, so the correlation follows from sums over distinct values.
    """
    cum = running_totals(dist.where("value is not null"), by, ["value"], {"_cum": F.col("n")}, bounds)
    r = F.col("_cum") - (F.col("n") - 1) / 2.0
    n, pos = F.col("n"), F.col("n_pos")
    s = cum.groupBy(*by).agg(
        F.sum(n).alias("all_n"), F.sum(pos).alias("all_pos"), F.sum(n * r).alias("sr"), F.sum(n * r * r).alias("srr"), F.sum(pos * r).alias("srp"),
    )
    # Correlation is unchanged by a linear map of the label's two ranks to 0 and 1.
    cov = F.col("srp") - F.col("sr") * F.col("all_pos") / F.col("all_n")
    var_r = F.col("srr") - F.col("sr") * F.col("sr") / F.col("all_n")
    var_y = F.col("all_pos") - F.col("all_pos") * F.col("all_pos") / F.col("all_n")
    return s.select(*by, F.col("all_n").alias("n"), F.when((var_r > 0) & (var_y > 0), cov / F.sqrt(var_r * var_y)).alias("rho"))
