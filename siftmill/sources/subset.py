"""A subset of entities with all of their detail rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.plans.sampling import choose, hash_int, with_cuts
from siftmill.plans.sizing import broadcast_if_small


def entity_subset(main: DataFrame, key: str, n: int, seed: int, children: Mapping[str, tuple[DataFrame, str]], grandchildren: Mapping[str, tuple[DataFrame, str, str, str]] | None = None) -> dict[str, DataFrame]:
    """Exactly ``n`` entities by hash order and their rows in every child table.

    ``children`` maps a name to ``(table, key)``; ``grandchildren`` maps a name to
    ``(table, its link key, child name, the child's link key)`` and follows the child's rows.
    """
    out = {"main": choose(main, key, seed, lambda _: F.lit(n))}
    ids = out["main"].select(key)
    for name, (child, child_key) in children.items():
        out[name] = child.join(broadcast_if_small(ids.withColumnRenamed(key, child_key)), child_key, "left_semi")
    for name, (table, link, via, via_link) in (grandchildren or {}).items():
        kept = out[via].select(F.col(via_link).alias(link))
        out[name] = table.join(broadcast_if_small(kept), link, "left_semi")
    return out


def row_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows by hash order."""
    return choose(df, key, seed, lambda total: F.least(total, F.lit(n)))


def effective_fraction(fraction: float, min_rows: int, n_rows: int) -> float:
    """Sampling share with a floor on the number of rows, at most 1."""
    return min(1.0, max(fraction, min_rows / n_rows)) if n_rows else 1.0


def fraction_sample(df: DataFrame, key: str, fraction: float, min_rows: int, seed: int) -> DataFrame:
    """Exactly ``floor(n * effective fraction)`` rows; the fraction is worked out inside the plan."""
    share = lambda n: F.floor(n * F.least(F.lit(1.0), F.greatest(F.lit(float(fraction)), F.lit(float(min_rows)) / n)))
    return choose(df, key, seed, share)


def stratified_sample(df: DataFrame, key: str, strata: list[str], fraction: float, seed: int) -> DataFrame:
    """``round(n * fraction)`` rows of every stratum (half to even, as in the original samples)."""
    cut = with_cuts(df, key, seed, [lambda n: F.bround(n * F.lit(fraction)).cast("long")], strata)
    return cut.where(F.col("_h") <= F.col("_cut0")).drop("_h", "_cut0")


def threshold_sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """About ``fraction`` of the rows without counting anything first."""
    return df.where(hash_int(key, seed, 1_000_000) < int(fraction * 1_000_000))
