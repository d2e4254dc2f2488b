"""The value distribution of many features at once.

All screening statistics start from the same collapsed table ``(feature, value, n, n_pos)``.
Rows are pre-aggregated before the only wide shuffle, so repeated values cost one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.plans.ordered import MAX_BUCKETS, null_safe_join, order_key, plan_buckets, running_totals
from siftmill.plans.sizing import BUCKET_BYTES, broadcast_if_small, input_bytes, once
from siftmill.session import cut_lineage


def numeric_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., feature, value)`` with one row per input row and numeric feature; dates and
    timestamps count as the time they stand for."""
    wide = df.select(*keep, *[F.nanvl(order_key(df, f), F.lit(None).cast("double")).alias(f) for f in features])
    return wide.unpivot(list(keep), list(features), "feature", "value")


def text_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Like :func:`numeric_long` with every feature as text."""
    wide = df.select(*keep, *[F.col(f).cast("string").alias(f) for f in features])
    return wide.unpivot(list(keep), list(features), "feature", "value")


def long_buckets(df: DataFrame, features: Sequence[str], buckets: int | None = None) -> list[float]:
    """Bucket boundaries over the values of all ``features`` together."""
    long = numeric_long(df, features)
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(1, -(-input_bytes(df) * max(1, len(features)) // BUCKET_BYTES)))
    return plan_buckets(long, "value", buckets)


def collapse(long: DataFrame, by: Sequence[str], label: str = "y") -> DataFrame:
    """One row per ``(by, value)``: ``n`` rows, ``n_pos`` of them positive."""
    return long.groupBy(*by, "value").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0).cast("long")).alias("n_pos")
    )


def quantile_points(dist: DataFrame, by: Sequence[str], probs: Sequence[float] | int, bounds: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ``(by..., i, q)``.

    ``dist`` is ``(by..., value, n)`` without NULL values. ``probs`` is a list of fractions, or a
    number k for ``0, 1/k, ..., 1``. The two neighbouring ranks of each quantile are found in the
    running counts, so no task ever holds a whole feature.
    """
    rows = running_totals(dist, by, ["value"], {"_cum": F.col("n")}, bounds, grand={"_total": F.col("n")})
    rows = rows.withColumns({"_first": F.col("_cum") - F.col("n"), "_last": F.col("_cum") - 1})
    top = F.col("_total") - 1
    if isinstance(probs, int):
        # Only the few quantiles whose position can fall on this value are looked at.
        step = F.lit(float(probs)) / F.greatest(top, F.lit(1))
        lo = F.greatest(F.lit(0), F.floor((F.col("_first") - 1) * step)).cast("int")
        hi = F.least(F.lit(probs), F.ceil((F.col("_last") + 1) * step)).cast("int")
        numbers, share = F.sequence(lo, hi), lambda i: i.cast("double") / probs
    else:
        listed = F.array(*[F.lit(float(p)) for p in probs])
        numbers, share = F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: F.get(listed, i)
    spots = F.transform(numbers, lambda i: F.struct(i.alias("i"), (top * share(i)).alias("h")))
    inside = lambda rank: (rank >= F.col("_first")) & (rank <= F.col("_last"))
    near = F.filter(spots, lambda s: inside(F.floor(s["h"])) | inside(F.ceil(s["h"])))
    hit = rows.select(*by, "value", "_first", "_last", F.explode(near).alias("s"))
    pair = hit.groupBy(*by, F.col("s.i").alias("i")).agg(
        F.max(F.when(inside(F.floor("s.h")), F.col("value"))).alias("lo"),
        F.max(F.when(inside(F.ceil("s.h")), F.col("value"))).alias("hi"),
        F.max(F.col("s.h") - F.floor("s.h")).alias("t"),
    )
    return pair.select(*by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t")).alias("q"))


def quantile_edges(dist: DataFrame, by: Sequence[str], bins: int, bounds: Sequence[float]) -> DataFrame:
    """Distinct sorted quantile edges per group: ``(by..., edges ARRAY<DOUBLE>)``."""
    points = quantile_points(dist, by, bins, bounds)
    return points.groupBy(*by).agg(F.array_sort(F.collect_set("q")).alias("edges"))


def rank_bins(dist: DataFrame, by: Sequence[str], bins: int, bounds: Sequence[float]) -> DataFrame:
    """Right-closed quantile bin of every value, by the group's interpolated edges.

    ``dist`` is ``(by..., value, n, ...)``, NULL values included. An edge that falls on a value, but
    for the last bits of its position or of its interpolation, lies on the side where doubles put
    it, as in SQL. Missing values get -1, and a group with fewer than three edges has one bin.
    """
    dist = once(dist, always=True)  # read for the edges and again for the bins
    edges = cut_lineage(quantile_edges(dist.where("value is not null").select(*by, "value", "n"), by, bins, bounds))
    rows = null_safe_join(dist, broadcast_if_small(edges), by)
    number = F.when(F.size("edges") < 3, F.lit(0)).otherwise(right_closed_bin(F.col("edges"), F.col("value")))
    return rows.withColumn("bin", F.when(F.col("value").isNull(), F.lit(-1)).otherwise(number)).drop("edges")


def pair_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows where both are filled; NULL when either is constant.

    ``corr`` itself divides by zero for a constant column in ANSI mode.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def interior(edges: Column) -> Column:
    """Edges without the first and the last one."""
    return F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))


def right_closed_bin(edges: Column, value: Column) -> Column:
    """Bin number for bins ``(a, b]`` with the lowest value in the first bin."""
    return F.size(F.filter(interior(edges), lambda e: e < value))


def left_closed_bin(edges: Column, value: Column) -> Column:
    """Bin number for bins ``[a, b)`` with open outer ends."""
    return F.size(F.filter(interior(edges), lambda e: e <= value))
