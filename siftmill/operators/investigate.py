"""Read-only questions about the training rows: where is the signal, is it stable, is it redundant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.columns import ID, LABEL, OBS
from siftmill.functions.dates import month_of
from siftmill.operators.metrics import METRICS, P, Y, auc, psi_severity, shift_from_counts
from siftmill.operators.screen import EDGE_ROW_BYTES, correlation_table, per_bin, value_counts_by_label
from siftmill.plans.distribution import long_buckets, numeric_long, quantile_edges, quantile_points, text_long
from siftmill.plans.ordered import null_safe_join, order_key, plan_buckets, running_totals
from siftmill.plans.sizing import broadcast_bounded, once
from siftmill.plans.skew import hot_split_join
from siftmill.session import cut_lineage

TOP = 10
HOT_SHARE = 0.001


def top_features(scores: DataFrame, by: str, n: int = TOP) -> DataFrame:
    """The n features with the largest value; names break ties."""
    return scores.orderBy(F.col(by).desc(), "feature").limit(n)


def as_numbers(df: DataFrame, features: Sequence[str], key: str = ID) -> DataFrame:
    """``df`` with each text feature replaced by how often its value occurs; missing stays missing."""
    text = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    if not text:
        return df
    told = frequency_encode(df, text, key)
    renamed = told.select(key, *[F.col(f"{f}__freq").cast("double").alias(f) for f in text])
    return df.drop(*text).join(renamed, key)


def _bins_of(df: DataFrame, features: Sequence[str], bins: int, buckets: int | None) -> DataFrame:
    """Bins with consecutive numbers; at most ``bins + 1`` rows per feature reach the window."""
    cells = per_bin(df, features, bins=bins, buckets=buckets)
    dense = F.dense_rank().over(Window.partitionBy("feature", F.col("bin") < 0).orderBy("bin")) - 1
    return cells.withColumn("bin", F.when(F.col("bin") < 0, F.col("bin")).otherwise(dense))


def mutual_information(df: DataFrame, features: Sequence[str], bins: int = 10, buckets: int | None = None, key: str = ID) -> DataFrame:
    """Mutual information (nats) between quantile bins of a feature and the label; text features
    count by the frequency of their values."""
    size = Window.partitionBy("feature")
    cells = _bins_of(as_numbers(df, features, key), features, bins, buckets)
    cells = cells.withColumns({"all_n": F.sum("n").over(size).cast("double"), "all_pos": F.sum("n_pos").over(size).cast("double")})

    def term(count, label_total):
        joint = count / F.col("all_n")
        return F.when(count > 0, joint * F.ln(joint * F.col("all_n") * F.col("all_n") / (F.col("n") * label_total))).otherwise(0.0)

    mi = term(F.col("n_pos"), F.col("all_pos")) + term(F.col("n") - F.col("n_pos"), F.col("all_n") - F.col("all_pos"))
    return cells.groupBy("feature").agg(F.sum(mi).alias("mi"))


def _rates(cells: DataFrame) -> DataFrame:
    """Rate and lift per bin; the window sees one row per bin or top category."""
    size = Window.partitionBy("feature")
    base = F.sum("n_pos").over(size).cast("double") / F.sum("n").over(size)
    rate = F.col("n_pos").cast("double") / F.col("n")
    return cells.withColumns({"target_rate": rate, "lift": F.try_divide(rate, base)}).drop("n_pos")


def target_rate_by_bin(df: DataFrame, features: Sequence[str], bins: int = 10, buckets: int | None = None) -> DataFrame:
    """Rows, target rate and lift per quantile bin; bin -1 holds the missing rows."""
    return _rates(_bins_of(df, features, bins, buckets)).select("feature", "bin", "n", "target_rate", "lift")


def target_rate_by_category(df: DataFrame, features: Sequence[str], top: int = TOP) -> DataFrame:
    """Same for text features: the most frequent values, everything else as ``other``.

    The top values are found in two steps: inside salted parts of a feature, then among the
    winners of all parts, so a feature with very many values is never ranked in one task.
    """
    dist = value_counts_by_label(df, features, text=True)
    filled = dist.where("value is not null").withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(256)))
    first = Window.partitionBy("feature", "_part").orderBy(F.col("n").desc(), "value")
    final = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    near = filled.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top)
    best = near.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= top).select("feature", "value", F.lit(True).alias("_top"))
    named = dist.join(broadcast_bounded(best, len(features) * top, 128), ["feature", "value"], "left")
    bin_name = F.when(F.col("value").isNull(), "missing").when(F.col("_top"), F.concat(F.lit("="), F.col("value"))).otherwise("other")
    cells = named.groupBy("feature", bin_name.alias("bin")).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
    return _rates(cells).select("feature", "bin", "n", "target_rate", "lift")


def stability_psi(df: DataFrame, features: Sequence[str], time_col: str = OBS, bins: int = 10, min_rows: int = 50, buckets: int | None = None, key: str = ID) -> DataFrame:
    """PSI between the early and the late half of the rows, split at the median time; text features
    count by the frequency of their values."""
    df = as_numbers(df, features, key)
    timed = df.withColumn("_t", order_key(df, time_col))
    times = timed.groupBy(F.col("_t").alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    half = quantile_points(times, [], [0.5], plan_buckets(timed, "_t", buckets)).first()["q"]
    long = numeric_long(timed.withColumn("_ref", F.col("_t") <= half), features, ["_ref"]).where("value is not null and _ref is not null")
    dist = long.groupBy("feature", "_ref", "value").agg(F.count("*").alias("n"))
    sides = dist.groupBy("feature").agg(F.sum(F.when(F.col("_ref"), F.col("n"))).alias("_a"), F.sum(F.when(~F.col("_ref"), F.col("n"))).alias("_b"))
    edges = quantile_edges(dist.where("_ref").select("feature", "value", "n"), ["feature"], bins, long_buckets(df, features, buckets))
    out = shift_from_counts(dist, broadcast_bounded(edges, len(features), EDGE_ROW_BYTES), ["feature"], [], bins)
    enough = sides.where((F.col("_a") > min_rows) & (F.col("_b") > min_rows)).select("feature")
    return out.join(broadcast_bounded(enough, len(features), 64), "feature")


def worse_segments(df: DataFrame, segments: Sequence[str], y: str = Y, p: str = P, tolerance: float = METRICS["auc"][1], min_rows: int = 200, buckets: int | None = None) -> DataFrame:
    """AUC of every value of the segment columns next to the AUC of all rows.

    ``worse`` marks segments of at least ``min_rows`` rows whose AUC is more than ``tolerance``
    lower. ``n_pos``, ``n_neg`` and ``n_all`` count the rows behind the numbers.
    """
    seg = auc(text_long(df, segments, [y, p]), ["feature", "value"], y, p, buckets)
    whole = auc(df, (), y, p, buckets).select(F.col("auc").alias("_all"), (F.col("n_pos") + F.col("n_neg")).alias("n_all"))
    out = seg.join(F.broadcast(whole)).withColumn("auc_gap", F.col("auc") - F.col("_all"))  # one row
    worse = (F.col("n_pos") + F.col("n_neg") >= min_rows) & F.coalesce(F.col("auc_gap") < -tolerance, F.lit(False))
    return out.select("feature", "value", "n_pos", "n_neg", "n_all", "auc", "auc_gap", worse.alias("worse"))


def monthly_drift(df: DataFrame, reference: Column, features: Sequence[str], time_col: str = OBS, bins: int = 10, min_rows: int = 50, buckets: int | None = None) -> DataFrame:
    """PSI of every feature and month next to the reference rows; text features count by the
    frequency of their values.

    ``n`` and ``n_ref`` count the filled values of the month and of the reference rows. A month
    without any, or a feature without a reference, has no PSI; with fewer than three edges it is 0,
    as everywhere. ``severity`` needs more than ``min_rows`` on both sides.
    """
    text = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    numbers = [f for f in features if f not in text]
    keys = ["feature", "_ref", "month"]
    marked = df.withColumn("_ref", reference).withColumn("month", F.when(~F.col("_ref"), month_of(time_col)))
    told = lambda long: long.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    parts = [told(numeric_long(marked, numbers, keys[1:]))] if numbers else []
    if text:
        often = F.sum("n").over(Window.partitionBy("feature", "value"))  # one row per month
        coded = told(text_long(marked, text, keys[1:])).withColumn("value", F.when(F.col("value").isNotNull(), often.cast("double")))
        parts.append(coded.groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    dist = once(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), always=True)  # read for the counts, the edges and the bins
    sides = dist.groupBy(*keys).agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n"))
    base = broadcast_bounded(sides.where("_ref").select("feature", F.col("n").alias("n_ref")), len(features), 64)
    filled = dist.where("value is not null").join(base.where("n_ref > 0").select("feature"), "feature", "left_semi")
    bounds = long_buckets(marked, numbers, buckets) if numbers else []
    edges = quantile_edges(filled.where("_ref").select("feature", "value", "n"), ["feature"], bins, bounds)
    psi = shift_from_counts(filled, broadcast_bounded(edges, len(features), EDGE_ROW_BYTES), ["feature"], ["month"], bins)
    months = sides.where(~F.col("_ref")).select("feature", "month", "n").join(base, "feature", "left")
    out = null_safe_join(months, psi, ["feature", "month"]).withColumn("n_ref", F.coalesce("n_ref", F.lit(0)))
    enough = (F.col("n") > min_rows) & (F.col("n_ref") > min_rows)
    return out.select("feature", "month", "n", "n_ref", "psi", F.when(enough, psi_severity(F.col("psi"))).alias("severity"))


def segment_insights(df: DataFrame, reference: Column, segments: Sequence[str], features: Sequence[str], y: str = Y, p: str = P, time_col: str = OBS, buckets: int | None = None) -> DataFrame:
    """Where the model is worse and which features drift, every number next to its row counts.

    Segments and months come from the rows that are not ``reference``; the months are compared
    with the reference rows. ``finding`` is empty where nothing stands out.
    """
    seg = worse_segments(df.where(~reference), segments, y, p, buckets=buckets)
    drift = monthly_drift(df, reference, features, time_col, buckets=buckets)
    none = lambda kind: F.lit(None).cast(kind)
    return seg.select(
        F.lit("segment").alias("kind"), "feature", "value", (F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("n_all").alias("n_ref"), "n_pos", "n_neg",
        "auc", "auc_gap", none("double").alias("psi"), F.when(F.col("worse"), "worse").alias("finding"),
    ).unionByName(drift.select(
        F.lit("drift").alias("kind"), "feature", F.col("month").alias("value"), "n", "n_ref", none("long").alias("n_pos"), none("long").alias("n_neg"),
        none("double").alias("auc"), none("double").alias("auc_gap"), "psi", F.col("severity").alias("finding"),
    ))


def missing_vs_target(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """Target rate of missing and present rows for features missing in 1 % to 99 % of the rows."""
    y, aggs = F.col(label).cast("double"), [F.count("*").alias("_n")]
    for f in features:
        gone = F.col(f).isNull()
        aggs += [F.count_if(gone).alias(f"m|{f}"), F.avg(F.when(gone, y)).alias(f"a|{f}"), F.avg(F.when(~gone, y)).alias(f"b|{f}")]
    items = F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col(f"`m|{f}`").cast("double") / F.col("_n")).alias("missing_rate"), F.col(f"`a|{f}`").alias("target_rate_missing"), F.col(f"`b|{f}`").alias("target_rate_present"))
        for f in features
    ])
    out = df.where(F.col(label).isNotNull()).agg(*aggs).select(F.explode(items).alias("p")).select("p.*")
    out = out.where((F.col("missing_rate") > 0.01) & (F.col("missing_rate") < 0.99))
    return out.withColumn("gap", F.abs(F.col("target_rate_missing") - F.col("target_rate_present")))


def rank_columns(df: DataFrame, features: Sequence[str], key: str = ID, buckets: int | None = None) -> DataFrame:
    """``(key, features...)`` with every value replaced by its average rank."""
    every = numeric_long(df, features, [key])
    long, empty = every.where("value is not null"), every.where("value is null")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    cum = running_totals(counts, ["feature"], ["value"], {"_cum": F.col("n")}, long_buckets(df, features, buckets), grand={"_all": F.col("n")})
    ranks = cum.select("feature", "value", (F.col("_cum") - (F.col("n") - 1) / 2.0).alias("r"), (F.col("n") > F.col("_all") * HOT_SHARE).alias("_often"))
    placed = hot_split_join(long, ranks, ["feature", "value"], F.col("_often"), int(len(features) / HOT_SHARE), key)
    placed = placed.select(key, "feature", "r").unionByName(empty.select(key, "feature", F.lit(None).cast("double").alias("r")))
    return placed.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("r"))).alias(f) for f in features])


def redundant_pairs(df: DataFrame, features: Sequence[str], limit: float = 0.9, key: str = ID, buckets: int | None = None) -> DataFrame:
    """Feature pairs with an absolute rank correlation above ``limit``.

    Ranks are taken over the filled values of each feature, frequencies for text; a pair uses the
    rows where both are filled.
    """
    fs = list(features)
    ranks = cut_lineage(rank_columns(as_numbers(df, fs, key), fs, key, buckets))
    return correlation_table(ranks, fs).select("a", "b", F.abs("corr").alias("corr")).where(F.col("corr") > limit)


def frequency_encode(df: DataFrame, features: Sequence[str], key: str = ID) -> DataFrame:
    """``(key, <feature>__freq...)``: each category replaced by how often it occurs, NULL for a
    missing one."""
    every = text_long(df, features, [key])
    long, empty = every.where("value is not null"), every.where("value is null")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("freq"))
    total = counts.groupBy("feature").agg(F.sum("freq").alias("_all"))
    marked = counts.join(broadcast_bounded(total, len(features), 64), "feature").select("feature", "value", "freq", (F.col("freq") > F.col("_all") * HOT_SHARE).alias("_often"))
    placed = hot_split_join(long, marked, ["feature", "value"], F.col("_often"), int(len(features) / HOT_SHARE), key)
    placed = placed.select(key, "feature", "freq").unionByName(empty.select(key, "feature", F.lit(None).cast("long").alias("freq")))
    return placed.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("freq"))).alias(f"{f}__freq") for f in features])


QUESTIONS = {
    "mutual_info": mutual_information, "target_rate_by_bin": target_rate_by_bin, "stability_psi": stability_psi,
    "missing_vs_target": missing_vs_target, "redundant_pairs": redundant_pairs,
}
