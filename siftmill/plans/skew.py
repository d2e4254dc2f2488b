"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.plans.sizing import LARGE_BYTES, input_bytes

SALTS = 1024


def hot_split_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], hot: Column, hot_rows: int, row_id: str, always: bool = False) -> DataFrame:
    """Left join of ``rows`` with a lookup that has one row per key.

    ``hot`` marks lookup rows whose key is frequent in ``rows``; at most ``hot_rows`` of them can
    exist (a key with more than a share s of the rows exists at most 1/s times), so that part is
    broadcast. Rows already answered get a random salt and are spread evenly over the shuffle
    that joins the remaining keys. No row is dropped or handled twice. Small inputs take a plain
    join unless ``always`` is set.
    """
    if not always and input_bytes(rows) <= LARGE_BYTES:
        return rows.join(lookup, list(keys), "left")
    values = [c for c in lookup.columns if c not in keys]
    marked = lookup.withColumn("_hot", F.coalesce(hot, F.lit(False)))
    frequent = marked.where("_hot").select(*keys, *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_done"))
    if hot_rows * 256 <= 64 << 20:
        frequent = F.broadcast(frequent)
    rest = marked.where(~F.col("_hot")).select(*keys, *[F.col(v).alias(f"_c_{v}") for v in values], F.lit(-1).alias("_salt"))
    first = rows.join(frequent, list(keys), "left")
    salt = F.when(F.col("_done"), F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    out = first.withColumn("_salt", salt).join(rest, [*keys, "_salt"], "left")
    return out.withColumns({v: F.coalesce(F.col(f"_h_{v}"), F.col(f"_c_{v}")) for v in values}).drop(
        "_done", "_salt", *[f"_h_{v}" for v in values], *[f"_c_{v}" for v in values]
    )
