"""Lagged values and trailing means of an ordered series, optionally per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.label import LabelRule, label_column
from siftmill.plans.ordered import history_columns, plan_buckets


def history_features(
    df: DataFrame,
    fields: Mapping[str, Mapping[str, Sequence[int]]],
    order: Sequence[str],
    by: Sequence[str] = (),
    label: LabelRule | None = None,
    buckets: int | None = None,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """``<column>_lag<k>`` and ``<column>_mean<n>`` from earlier rows only.

    ``fields`` maps a column to ``{"lags": [...], "means": [...]}``; the label's source column is
    used as 0/1. ``order`` must end with a unique column. The rows are cut along ``order[0]`` so
    neither a global series nor one very long entity ends up in a single task.
    """
    work, make, helper = df, {}, None
    for c, spec in fields.items():
        source = c
        if label is not None and c == label.column:
            helper = "_history_label"
            work, source = work.withColumn(helper, label_column(label).cast("double")), helper
        for k in spec.get("lags", ()):
            make[f"{c}_lag{k}"] = ("lag", (source, k))
        for n in spec.get("means", ()):
            make[f"{c}_mean{n}"] = ("mean", (source, n))
    reach = max((k for _, (_, k) in make.values()), default=1)
    bounds = plan_buckets(df, order[0], buckets)
    out = history_columns(work, list(by), list(order), make, reach, bounds, chunk_rows)
    return out.drop(helper) if helper else out


def history_names(fields: Mapping[str, Mapping[str, Sequence[int]]]) -> list[str]:
    """Names of the generated columns: they only use earlier rows, so the leak scan trusts them."""
    return [f"{c}_lag{k}" for c, s in fields.items() for k in s.get("lags", ())] + [f"{c}_mean{n}" for c, s in fields.items() for n in s.get("means", ())]


def mark_history(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Put the trust flag into the column metadata."""
    meta = {f.name: f.metadata for f in df.schema.fields}
    return df.select(*[F.col(c).alias(c, metadata={**meta[c], "availability": "history"}) if c in names else F.col(c) for c in df.columns])
