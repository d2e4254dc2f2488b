"""Ordered computations that never put a whole group into one task.

A running total, a row position or a lag over a long ordered group is cut along the order
column into buckets whose boundaries are literals. The boundaries only steer the work, so any
boundaries give the same result; they are read once from an approximate percentile and then
fixed, which keeps every branch of the plan and every retried task consistent.

* ``running_totals``: totals inside ``(group, bucket)`` plus the totals of earlier buckets.
* ``row_positions``: running total of ones.
* ``history_columns``: rows are cut into chunks of equal length by position and each chunk
  gets the last rows of the chunk before it, so ``lag`` and ``rows between`` frames are exact.

Because the boundaries are quantiles over all rows, a bucket holds about ``1/n`` of the rows in
total; a single group holding a third of the table is therefore spread over a third of the
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.plans.sizing import BUCKET_BYTES, input_bytes, once

BUCKET = "_bucket"
MAX_BUCKETS = 16_384
MAX_TEXT_BUCKETS = 256
TEXT_SAMPLE = 20_000
SAMPLE_BYTES = 1 << 30


def order_key(df: DataFrame, name: str) -> Column:
    """Monotone double form of an order column, independent of the session time zone."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(c.cast("date")).cast("double") * 86_400.0
        return day + F.hour(c) * 3600.0 + F.minute(c) * 60.0 + F.date_part(F.lit("SECOND"), c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def instant(df: DataFrame, name: str) -> Column:
    """Microseconds of a date or timestamp column as a whole number, independent of the session time zone."""
    key = order_key(df, name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    return F.round(key * (86_400e6 if isinstance(kind, T.DateType) else 1e6)).cast("long")


def plan_buckets(df: DataFrame, order: str, buckets: int | None = None, bytes_per_bucket: int = BUCKET_BYTES) -> list[float]:
    """Interior bucket boundaries for ``order``; empty when one bucket is small enough.

    Without ``buckets`` the number follows the optimizer's size estimate. Large inputs are
    sampled for the boundaries (rows are never dropped from the computation itself).
    """
    size = input_bytes(df)
    n = buckets if buckets is not None else min(MAX_BUCKETS, -(-size // bytes_per_bucket))
    if n <= 1:
        return []
    if isinstance(df.schema[order].dataType, T.StringType):
        return _text_buckets(df, order, min(n, MAX_TEXT_BUCKETS), size)
    keys = df.select(order_key(df, order).alias("k")).where(F.col("k").isNotNull() & ~F.isnan("k"))
    if size > SAMPLE_BYTES:
        keys = keys.sample(fraction=max(1e-6, SAMPLE_BYTES / size), seed=7)
    fractions = ", ".join(f"{i / n!r}D" for i in range(1, n))
    found = keys.agg(F.expr(f"percentile_approx(k, array({fractions}), {max(1000, 20 * n)})").alias("q")).first()["q"]
    return sorted(set(found or []))


def _text_buckets(df: DataFrame, order: str, n: int, size: int) -> list[str]:
    """Boundaries of a text order column: quantiles of rows drawn from the whole column, so that
    sorted input and frequent values give even buckets."""
    values = df.select(F.col(order).alias("k")).where(F.col("k").isNotNull())
    if size > SAMPLE_BYTES:
        values = values.sample(fraction=max(1e-6, SAMPLE_BYTES / size), seed=7)
    drawn = values.withColumn("_r", F.rand(7)).orderBy("_r").limit(TEXT_SAMPLE).select("k").collect()
    found = sorted((r["k"] for r in drawn), key=lambda v: v.encode())
    return list(dict.fromkeys(found[len(found) * i // n] for i in range(1, n))) if found else []


def assign_bucket(df: DataFrame, order: str, bounds: Sequence[float]) -> DataFrame:
    """Add the bucket number of each row; equal order values always share a bucket."""
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    if isinstance(bounds[0], str):
        limits = F.array(*[F.lit(b) for b in bounds])
        return df.withColumn(BUCKET, F.coalesce(F.size(F.filter(limits, lambda b: b <= F.col(order))), F.lit(0)))
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_order_key", outputCol="_order_cut", handleInvalid="keep")
    keyed = df.withColumn("_order_key", order_key(df, order))
    # NULL sorts first in Spark, so it belongs to the first bucket.
    number = F.when(F.col("_order_key").isNull(), F.lit(0)).otherwise(F.col("_order_cut").cast("int"))
    return cut.transform(keyed).withColumn(BUCKET, number).drop("_order_key", "_order_cut")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the right key copies are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        test = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = test if cond is None else cond & test
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    totals: dict[str, Column],
    bounds: Sequence[float],
    bucket_on: str | None = None,
    grand: dict[str, Column] | None = None,
    lowest: dict[str, Column] | None = None,
    extremes: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Inclusive running totals per group, exact for any set of bucket boundaries.

    ``extremes`` adds running minima and maxima: a name with ("min" or "max", column).

    ``order[0]`` (or ``bucket_on``) is the column the boundaries were planned for. ``grand`` adds
    whole-group totals to every row and ``lowest`` whole-group minima; they travel with the bucket offsets, so no join on the
    group alone (which a dominant group would skew) is needed.
    """
    whole_group = {**{n: (F.sum, c) for n, c in (grand or {}).items()}, **{n: (F.min, c) for n, c in (lowest or {}).items()}}
    running = {**{n: (F.sum, c) for n, c in totals.items()}, **{n: (getattr(F, kind), c) for n, (kind, c) in (extremes or {}).items()}}
    lead = bucket_on or (order[0] if isinstance(order[0], str) else None)
    cut = assign_bucket(once(df, always=True) if bounds else df, lead, bounds)
    if not bounds:
        within = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by, BUCKET)
        made = {name: fn(c).over(within) for name, (fn, c) in running.items()}
        return cut.withColumns({**made, **{name: fn(c).over(whole) for name, (fn, c) in whole_group.items()}}).drop(BUCKET)
    # A struct key keeps NULL groups apart and lets window, aggregate and join share one layout.
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    cut = cut.withColumn("_g", group)
    within = Window.partitionBy("_g", BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cut.withColumns({name: fn(c).over(within) for name, (fn, c) in running.items()})
    parts = {**{f"_off_{n}": made for n, made in running.items()}, **whole_group}
    per_bucket = cut.groupBy("_g", BUCKET).agg(*[fn(c).alias(n) for n, (fn, c) in parts.items()])
    before = Window.partitionBy("_g").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    offsets = per_bucket.select(
        "_g", BUCKET,
        *[F.coalesce(F.sum(f"_off_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals],
        *[getattr(F, kind)(f"_off_{n}").over(before).alias(f"_off_{n}") for n, (kind, _) in (extremes or {}).items()],
        *[fn(n).over(whole).alias(n) for n, (fn, _) in whole_group.items()],
    )
    joined = inner.join(offsets, ["_g", BUCKET], "left")
    shifted = {n: F.col(n) + F.col(f"_off_{n}") for n in totals}
    shifted |= {n: (F.least if kind == "min" else F.greatest)(n, f"_off_{n}") for n, (kind, _) in (extremes or {}).items()}
    return joined.withColumns(shifted).drop("_g", BUCKET, *[f"_off_{n}" for n in running])


def row_positions(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], bounds: Sequence[float], name: str = "_pos", bucket_on: str | None = None) -> DataFrame:
    """Zero-based position of every row inside its group."""
    return running_totals(df, by, order, {name: F.lit(1).cast("long")}, bounds, bucket_on).withColumn(name, F.col(name) - 1)


def history_columns(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    make: dict[str, tuple[str, object]],
    reach: int,
    bounds: Sequence[float],
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Window columns that look back at most ``reach`` rows.

    ``make`` maps an output name to ``(kind, args)``: ``("lag", (column, k))`` or
    ``("mean", (column, n))``. Without boundaries this is a plain window per group; with
    boundaries each group is cut into chunks of ``chunk_rows`` and every chunk receives the
    ``reach`` rows before it.
    """
    def over(window):
        out = {}
        for name, (kind, (column, k)) in make.items():
            c = column if isinstance(column, Column) else F.col(column)
            out[name] = F.lag(c, k).over(window) if kind == "lag" else F.avg(c).over(window.rowsBetween(-k, -1))
        return out

    if not bounds:
        return df.withColumns(over(Window.partitionBy(*by).orderBy(*order)))
    size = max(chunk_rows, reach, 1)
    placed = row_positions(df, by, order, bounds)
    chunk = F.floor(F.col("_pos") / size)
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))
    ahead = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo"))
    homes = F.when(F.col("_pos") % size >= size - reach, F.array(own, ahead)).otherwise(F.array(own))
    spread = placed.withColumn("_home", F.explode(homes)).withColumns({"_chunk": F.col("_home.chunk"), "_halo": F.col("_home.halo")})
    window = Window.partitionBy(*by, "_chunk").orderBy(*order)
    return spread.withColumns(over(window)).where(~F.col("_halo")).drop("_home", "_chunk", "_halo", "_pos")


def earlier_max(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, bounds: Sequence[float]) -> DataFrame:
    """Largest ``value`` among the earlier rows of the group, exact for any bucket boundaries."""
    cut = assign_bucket(once(df, always=True) if bounds else df, order[0], bounds).withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    w = Window.partitionBy("_g", BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn(name, F.max(value).over(w))
    if not bounds:
        return inner.drop("_g", BUCKET)
    before = Window.partitionBy("_g").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy("_g", BUCKET).agg(F.max(value).alias("_top")).select("_g", BUCKET, F.max("_top").over(before).alias("_top"))
    return inner.join(tops, ["_g", BUCKET], "left").withColumn(name, F.greatest(name, "_top")).drop("_g", BUCKET, "_top")
