"""Random choices as an order by md5 of seed and row id.

The order does not depend on the layout of the data, is the same in every SQL engine, and
an exact count of rows can be chosen with one narrow pass: the counts per hash prefix find the
prefix where the k-th row lies, and only the rows of that prefix are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.plans.ordered import null_safe_join
from siftmill.plans.sizing import broadcast_if_small, once
from siftmill.session import cut_lineage

PREFIX_HEX = 4
_ALL = "_all"


def hash_hex(key: Column | str, seed: int | str) -> Column:
    """Order key: md5 of ``seed|key`` as 32 hex digits."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_int(key: Column | str, seed: int | str, modulo: int) -> Column:
    """Uniform integer in ``[0, modulo)`` from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("long") % modulo


def hash_cuts(df: DataFrame, key: str, seed: int | str, counts: Sequence[Callable[[Column], Column]], strata: Sequence[str] = ()) -> DataFrame:
    """Hash of the k-th row per stratum, for several k.

    Each entry of ``counts`` turns the stratum size into k. The result has one row per stratum
    with ``_cut0, _cut1, ...``: NULL means k = 0. Reads only the key and the strata columns.
    """
    ids = df.select(*strata, F.col(key).alias("_key"))
    by = list(strata)
    if not by:
        ids, by = ids.withColumn(_ALL, F.lit(0)), [_ALL]
    ids = ids.withColumn("_h", hash_hex("_key", seed)).withColumn("_prefix", F.substring("_h", 1, PREFIX_HEX))
    sizes = ids.groupBy(*by, "_prefix").agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*by).orderBy("_prefix")
    whole = Window.partitionBy(*by)
    sizes = sizes.withColumns({"_cum": F.sum("_n").over(ordered), "_total": F.sum("_n").over(whole)})
    # Asking for more rows than there are means all of them.
    wanted = F.array(*[F.least(fn(F.col("_total")).cast("long"), F.col("_total")) for fn in counts])
    edge = (
        sizes.select(*by, "_prefix", "_n", "_cum", F.posexplode(wanted).alias("_i", "_k"))
        .where((F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
        .select(*by, "_prefix", "_i", (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_need"))
    )
    # One row per stratum and cut: written first, so its true size decides and the ids stay in place.
    near = null_safe_join(ids, broadcast_if_small(cut_lineage(edge)), [*by, "_prefix"], "inner")
    rank = F.row_number().over(Window.partitionBy(*by, "_i", "_prefix").orderBy("_h", "_key"))
    hit = near.withColumn("_rank", rank).where(F.col("_rank") == F.col("_need"))
    cuts = hit.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_h"))).alias(f"_cut{i}") for i in range(len(counts))])
    return cuts


def with_cuts(df: DataFrame, key: str, seed: int | str, counts: Sequence[Callable[[Column], Column]], strata: Sequence[str] = ()) -> DataFrame:
    """``df`` with its own hash ``_h`` and the cuts of its stratum; the wide table is not shuffled
    when the cuts are few."""
    df = once(df)
    cuts = hash_cuts(df, key, seed, counts, strata)
    base, by = df.withColumn("_h", hash_hex(key, seed)), list(strata)
    if not by:
        base, by = base.withColumn(_ALL, F.lit(0)), [_ALL]
        return null_safe_join(base, F.broadcast(cuts), by).drop(_ALL)  # one row
    # A few strata would leave a few tasks to join all rows, so the cuts are written and broadcast while small.
    return null_safe_join(base, broadcast_if_small(cut_lineage(cuts)), by)


def choose(df: DataFrame, key: str, seed: int | str, count: Callable[[Column], Column], strata: Sequence[str] = ()) -> DataFrame:
    """Exactly ``count(n)`` rows per stratum, chosen by hash order. ``key`` must be unique."""
    out = with_cuts(df, key, seed, [count], strata)
    return out.where(F.col("_h") <= F.col("_cut0")).drop("_h", "_cut0")


def take_fraction(df: DataFrame, key: str, seed: int | str, fraction: float) -> DataFrame:
    """About ``fraction`` of the rows by hash threshold: a map-only filter, no count needed."""
    return df.where(hash_int(key, seed, 1_000_000) < int(fraction * 1_000_000))
