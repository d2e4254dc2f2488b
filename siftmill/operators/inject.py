"""Known issues put into clean data on purpose, and recounts of what was put in.

All choices are by hash of a unique key, so they do not depend on the layout of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.dates import month_of
from siftmill.plans.ordered import MAX_BUCKETS, row_positions
from siftmill.plans.sampling import hash_hex, hash_int, with_cuts
from siftmill.plans.sizing import BUCKET_BYTES, input_bytes
from siftmill.session import cut_lineage

HASH_SPAN = float(16**12)


def _share(fraction: float, at_least: int = 1) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.lit(at_least), F.floor(n * F.lit(fraction))).cast("long")


def _chosen() -> Column:
    return F.coalesce(F.col("_h") <= F.col("_cut0"), F.lit(False))


def _pick(df: DataFrame, key: str, seed, fraction: float, at_least: int = 1, among: Column | None = None) -> DataFrame:
    """``df`` plus ``_pick``: exactly ``max(at_least, int(n * fraction))`` of the candidate rows."""
    if among is None:
        return with_cuts(df, key, seed, [_share(fraction, at_least)]).withColumn("_pick", _chosen()).drop("_h", "_cut0")
    flagged = df.withColumn("_cand", F.coalesce(among, F.lit(False)))
    cut = with_cuts(flagged, key, seed, [_share(fraction, at_least)], ["_cand"])
    return cut.withColumn("_pick", F.col("_cand") & _chosen()).drop("_h", "_cut0", "_cand")


def plant_sentinel(df: DataFrame, key: str, column: str, value, fraction: float, seed, only_missing: bool = False) -> DataFrame:
    """Replace a share of the values (or of the missing ones) by a placeholder."""
    picked = _pick(df, key, seed, fraction, among=F.col(column).isNull() if only_missing else None)
    kind = df.schema[column].dataType
    return picked.withColumn(column, F.when(F.col("_pick"), F.lit(value).cast(kind)).otherwise(F.col(column))).drop("_pick")


def plant_duplicate_rows(df: DataFrame, key: str, fraction: float, seed) -> DataFrame:
    """Append exact copies of a share of the rows."""
    picked = _pick(df, key, seed, fraction)
    copies = F.when(F.col("_pick"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return picked.withColumn("_copy", F.explode(copies)).drop("_pick", "_copy")


def hash_bounds(n: int) -> list[float]:
    """Bucket boundaries for a uniform hash: known without looking at the data."""
    return [HASH_SPAN * i / n for i in range(1, n)]


def hash_positions(df: DataFrame, key: str, seed, buckets: int | None = None, name: str = "_pos") -> DataFrame:
    """Position of every row in the hash order of its key; buckets follow the input size."""
    buckets = buckets or max(16, min(MAX_BUCKETS, -(-input_bytes(df) // BUCKET_BYTES)))
    hashed = df.withColumn("_hex", hash_hex(key, seed))
    hashed = hashed.withColumn("_hd", F.conv(F.substring("_hex", 1, 12), 16, 10).cast("double"))
    return row_positions(hashed, [], ["_hd", "_hex"], hash_bounds(buckets), name).drop("_hd", "_hex")


def plant_duplicate_keys(df: DataFrame, key: str, fraction: float, seed, buckets: int | None = None) -> DataFrame:
    """Append rows whose content comes from some rows and whose key comes from others.

    The first n rows of the hash order give the content, the next n give the key; every
    original row stays.
    """
    size = _share(fraction)
    cut = with_cuts(df, key, seed, [size, lambda n: 2 * size(n)])
    near = cut.where(F.col("_h") <= F.col("_cut1"))
    target = hash_positions(near.where(F.col("_h") <= F.col("_cut0")).drop("_h", "_cut0", "_cut1"), key, seed, buckets)
    source = hash_positions(near.where(F.col("_h") > F.col("_cut0")).select(key), key, seed, buckets).withColumnRenamed(key, "_new_key")
    extra = target.join(source, "_pos").withColumn(key, F.col("_new_key")).select(*df.columns)
    return df.unionByName(extra)


def plant_variants(df: DataFrame, key: str, column: str, value: str, variants: Sequence[str], fraction: float, seed) -> DataFrame:
    """Write a share of one category in other ways."""
    picked = _pick(df, key, seed, fraction, len(variants), F.col(column) == value)
    which = F.element_at(F.array(*[F.lit(v) for v in variants]), (hash_int(key, f"{seed}v", len(variants)) + 1).cast("int"))
    return picked.withColumn(column, F.when(F.col("_pick"), which).otherwise(F.col(column))).drop("_pick")


def plant_missing_months(df: DataFrame, time_col: str, months: Sequence[str]) -> DataFrame:
    """Remove whole months of rows."""
    return df.where(~month_of(time_col).isin(*months) | F.col(time_col).isNull())


def plant_post_outcome(df: DataFrame, key: str, column: str, label: str, noise: float, seed, jitter: float = 0.05) -> DataFrame:
    """Add a column that mostly equals the outcome: flipped for a share of rows, slightly jittered."""
    flip = hash_int(key, seed, 1_000_000) < int(noise * 1_000_000)
    y = F.col(label).cast("double")
    spread = (hash_int(key, f"{seed}j", 2001) - 1000) / 1000.0 * jitter
    return df.withColumn(column, F.when(flip, 1 - y).otherwise(y) + spread)


def plant_after_cutoff(df: DataFrame, key: str, column: str, fraction: float, seed, max_days: int = 365) -> DataFrame:
    """Move a share of the relative event days behind the observation point."""
    picked = _pick(df, key, seed, fraction)
    late = (1 + hash_int(key, f"{seed}d", max_days - 1)).cast(df.schema[column].dataType)
    return picked.withColumn(column, F.when(F.col("_pick"), late).otherwise(F.col(column))).drop("_pick")


def shuffle_label(df: DataFrame, key: str, label: str, seed, buckets: int | None = None) -> DataFrame:
    """Labels in random order: row i of one hash order gets the label of row i of another one."""
    rows = hash_positions(df.drop(label), key, f"{seed}a", buckets)
    labels = hash_positions(df.select(key, label), key, f"{seed}b", buckets).select("_pos", label)
    return rows.join(labels, "_pos").drop("_pos").select(*df.columns)


def shrink_split(df: DataFrame, key: str, label: str, n_pos: int, seed) -> DataFrame:
    """Keep ``n_pos`` positives and negatives at the same rate."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    k = min(n_pos, sizes["p"])
    m = min(sizes["n"], round(k * sizes["n"] / max(sizes["p"], 1)))
    kept = with_cuts(df.where(F.col(label).isin(0, 1)), key, seed, [lambda n: F.lit(k), lambda n: F.lit(m)], [label])
    keep = F.when(F.col(label) == 1, F.col("_h") <= F.col("_cut0")).otherwise(F.col("_h") <= F.col("_cut1"))
    return kept.where(keep).drop("_h", "_cut0", "_cut1")


def plant_in_turn(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply several injections one after another, writing the table in between.

    Every step reads its input twice (once for the choice of rows); without the cut a chain of
    steps would multiply the scans.
    """
    for step in steps:
        df = cut_lineage(step(df))
    return df


def recount_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows that hold any of the planted values."""
    return df.agg(F.count_if(F.col(column).isin(*values)).alias("n_rows"))


def recount_duplicate_key(df: DataFrame, key: str) -> DataFrame:
    """Surplus rows per key after exact copies are removed."""
    versions = df.distinct().groupBy(key).agg(F.count("*").alias("_n"))
    return versions.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_rows"))
