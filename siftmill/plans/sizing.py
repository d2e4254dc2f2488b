"""Size checks from the optimizer's own statistics; no job is started.

Two numbers with different uses: ``estimated_bytes`` is Catalyst's upper bound (joins multiply
their sides) and guards broadcasts; ``input_bytes`` is the size of the scanned leaves and steers
how finely work is cut, where a wrong guess costs time but never correctness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import cut_lineage

BROADCAST_BYTES = 64 << 20
BUCKET_BYTES = 256 << 20
LARGE_BYTES = 1 << 30


UNKNOWN_BYTES = 1 << 62


def _size(plan) -> int:
    """Statistics of one plan node; joins of joins can exceed what Python parses as a number."""
    try:
        return min(int(str(plan.stats().sizeInBytes())), UNKNOWN_BYTES)
    except ValueError:
        return UNKNOWN_BYTES


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``: an upper bound for scans, filters and aggregates."""
    return _size(df._jdf.queryExecution().optimizedPlan())


def input_bytes(df: DataFrame) -> int:
    """Bytes read by the plan: the sum over its leaves."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(_size(leaves.apply(i)) for i in range(leaves.size()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate stays below ``limit``.

    Beyond the limit the join is left to the planner, which shuffles both sides.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def broadcast_bounded(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a table whose row count is bounded by construction.

    ``rows`` comes from the schema or from parameters (features x bins, strata x cuts), never
    from the data, so the bound holds at any input size.
    """
    return F.broadcast(df) if rows * row_bytes <= limit else df


def settle(small: DataFrame, big: DataFrame) -> DataFrame:
    """Make a derived lookup table ready to be joined to ``big``.

    Next to a large table the lookup is written out first: its true size is then known, it is
    broadcast only if that size is small, and ``big`` is not shuffled for nothing. Next to a
    small table the adaptive planner decides.
    """
    if input_bytes(big) <= LARGE_BYTES:
        return small
    return broadcast_if_small(cut_lineage(small))


def once(df: DataFrame, always: bool = False) -> DataFrame:
    """Make sure a derived table that is about to be read by several branches is computed once.

    The branches need different columns, so the planner prunes them differently and does not
    share their shuffles. A plain scan is left alone: reading a few columns twice is cheaper than
    writing all of them. Small inputs are left alone too unless ``always`` is set.
    """
    if not always and input_bytes(df) <= LARGE_BYTES:
        return df
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    derived = any(f"{node} " in plan or f"{node}\n" in plan for node in ("Aggregate", "Join", "Window", "Generate"))
    return cut_lineage(df) if derived else df
