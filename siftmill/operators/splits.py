"""Time semantics: windows, random splits, maturity, shifts, validation of time expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, OBS, SPLIT, SPLIT_TIME, feature_columns
from siftmill.functions.dates import month_number, month_of, month_start, next_month_start
from siftmill.operators.label import LabelRule, label_column
from siftmill.plans.sampling import with_cuts
from siftmill.plans.sizing import broadcast_bounded

Windows = Mapping[str, tuple[str, str]]
# Fixed names: configuration window -> split.
WINDOW_SPLIT = {"train_valid": "train", "oot_dev": "oot_dev", "holdout": "holdout"}


def in_months(t: Column | str, months: tuple[str, str]) -> Column:
    """First month inclusive to last month inclusive, as a half-open range of timestamps."""
    c = F.col(t) if isinstance(t, str) else t
    lo, hi = month_start(months[0]), next_month_start(months[1])
    return (c >= F.lit(lo).cast("timestamp_ntz")) & (c < F.lit(hi).cast("timestamp_ntz"))


def assign_time_split(df: DataFrame, windows: Windows, time_col: str = SPLIT_TIME) -> DataFrame:
    """Label each row with its window; rows outside every window are left out."""
    name = None
    for key, months in windows.items():
        test, value = in_months(F.col(time_col).cast("timestamp_ntz"), months), F.lit(WINDOW_SPLIT.get(key, key))
        name = F.when(test, value) if name is None else name.when(test, value)
    return df.withColumn(SPLIT, name).where(F.col(SPLIT).isNotNull())


def valid_from_train(df: DataFrame, fraction: float, seed: int, key: str = ID) -> DataFrame:
    """Move exactly ``int(n_train * fraction)`` random train rows to ``valid``."""
    cut = with_cuts(df, key, seed, [lambda n: F.floor(n * F.lit(fraction))], [SPLIT])
    moved = (F.col(SPLIT) == "train") & F.coalesce(F.col("_h") <= F.col("_cut0"), F.lit(False))
    return cut.withColumn(SPLIT, F.when(moved, "valid").otherwise(F.col(SPLIT))).drop("_h", "_cut0")


def assign_random_split(df: DataFrame, fractions: Mapping[str, float], seed: int, key: str = ID, label: str = LABEL) -> DataFrame:
    """Label-stratified split with ``int(n * fraction)`` rows per class and split; the rest is left out."""
    names = list(fractions)

    def upto(i: int):
        return lambda n: sum((F.floor(n * F.lit(float(fractions[k]))) for k in names[: i + 1]), F.lit(0))

    cut = with_cuts(df.where(F.col(label).isNotNull()), key, seed, [upto(i) for i in range(len(names))], [label])
    name = None
    for i, k in enumerate(names):
        test = F.col("_h") <= F.col(f"_cut{i}")
        name = F.when(test, k) if name is None else name.when(test, k)
    return cut.withColumn(SPLIT, name).where(F.col(SPLIT).isNotNull()).drop("_h", *[f"_cut{i}" for i in range(len(names))])


def maturity_check(df: DataFrame, status: str, unfinished: Sequence[str], time_col: str, threshold: float, months: tuple[str, str] | None = None) -> DataFrame:
    """Share of unfinished statuses per month, with a flag above ``threshold``."""
    base = df.where(F.col(time_col).isNotNull())
    if months:
        base = base.where(in_months(F.col(time_col).cast("timestamp_ntz"), months))
    share = F.avg(F.col(status).cast("string").isin(*unfinished).cast("double"))
    out = base.groupBy(month_of(time_col).alias("month")).agg(F.count("*").alias("n"), share.alias("share"))
    return out.withColumn("data_fatal", F.col("share") > threshold)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(SPLIT).agg(F.count("*").alias("n"), F.avg(F.col(LABEL).cast("double")).alias("bad_rate"))


def missing_rates(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing rate of every feature per group: one pass, partial sums only."""
    rates = df.groupBy(*by).agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return rates.unpivot(list(by), list(features), "feature", "missing_rate")


def missing_rate_shift(df: DataFrame, features: Sequence[str], threshold: float, left: str = "train", right: str = "oot_dev") -> DataFrame:
    """Features whose missing rate differs by more than ``threshold`` between two splits."""
    two = df.where(F.col(SPLIT).isin(left, right))
    rates = [F.avg(F.when(F.col(SPLIT) == s, F.col(f).isNull().cast("double"))).alias(f"{i}|{f}") for f in features for i, s in (("a", left), ("b", right))]
    wide = two.agg(*rates)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`a|{f}`").alias("rate_left"), F.col(f"`b|{f}`").alias("rate_right")) for f in features])
    long = wide.select(F.explode(pairs).alias("p")).select("p.*")
    out = long.withColumn("shift", F.abs(F.col("rate_left") - F.col("rate_right")))
    return out.where(F.col("shift") > threshold)


def label_crosstab(df: DataFrame, field: str, rule: LabelRule) -> DataFrame:
    """Raw rows counted per field value and label, unlabelled rows included."""
    return df.groupBy(F.col(field).cast("string").alias("v"), label_column(rule).cast("int").alias("y")).agg(F.count("*").alias("n"))


def time_expression_share(df: DataFrame, expressions: Mapping[str, Column], minimum: float = 0.99) -> DataFrame:
    """Share of rows for which each time expression has a value; one aggregate over the table."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count(e).alias(k) for k, e in expressions.items()])
    long = wide.unpivot(["_n"], list(expressions), "expression", "n_ok")
    share = F.try_divide(F.col("n_ok").cast("double"), F.col("_n"))
    return long.select("expression", F.col("_n").alias("n_rows"), "n_ok", share.alias("share"), (share >= minimum).alias("ok"))


def date_field_share(df: DataFrame, fields: Sequence[str], minimum: float = 0.99) -> DataFrame:
    """Share of filled values that parse as a date, per field declared as date."""
    aggs = []
    for f in fields:
        aggs += [F.count(F.col(f)).alias(f"n|{f}"), F.count(F.expr(f"try_cast(cast(`{f}` as string) as date)")).alias(f"ok|{f}")]
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`n|{f}`").alias("n_filled"), F.col(f"`ok|{f}`").alias("n_ok")) for f in fields])
    long = df.agg(*aggs).select(F.explode(items).alias("p")).select("p.*")
    share = F.try_divide(F.col("n_ok").cast("double"), F.col("n_filled"))
    return long.withColumns({"share": share, "ok": (F.col("n_filled") == 0) | (share >= minimum)})


def windows_ordered(windows: Windows) -> bool:
    """Every window runs forward and ends before the next one starts."""
    spans = list(windows.values())
    return all(lo <= hi for lo, hi in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def window_classes(df: DataFrame, time_col: str, windows: Windows, label: Column) -> DataFrame:
    """Positive and negative rows per window in one aggregate; both must be present."""
    month, aggs = month_of(time_col), []
    for key, (lo, hi) in windows.items():
        inside = month.between(lo, hi)
        aggs += [F.count_if(inside & (label == 1)).alias(f"p|{key}"), F.count_if(inside & (label == 0)).alias(f"n|{key}")]
    items = F.array(*[F.struct(F.lit(k).alias("window"), F.col(f"`p|{k}`").alias("n_pos"), F.col(f"`n|{k}`").alias("n_neg")) for k in windows])
    long = df.agg(*aggs).select(F.explode(items).alias("w")).select("w.*")
    ordered = windows_ordered(windows)
    return long.withColumn("ok", F.lit(ordered) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def dataset_fingerprint(train: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Rows, features, positive rate, mean missing rate and months spanned, in one aggregate."""
    fs = list(features) if features is not None else feature_columns(train)
    missing = sum((F.avg(F.col(f).isNull().cast("double")) for f in fs), F.lit(0.0)) / len(fs)
    t = SPLIT_TIME if SPLIT_TIME in train.columns else OBS
    span = month_number(F.max(t)) - month_number(F.min(t)) if t in train.columns else F.lit(0)
    return train.agg(
        F.count("*").alias("n_samples"), F.lit(len(fs)).alias("n_features"), F.avg(F.col(LABEL).cast("double")).alias("bad_rate"),
        missing.alias("missing_rate"), span.cast("int").alias("time_span_months"),
    )


def modeling_profile(train: DataFrame, categorical: Sequence[str], exact: bool = True) -> DataFrame:
    """Number of categorical columns and the largest cardinality."""
    if not categorical:
        return train.sparkSession.range(1).select(F.lit(0).alias("n_categorical"), F.lit(0).cast("long").alias("max_cardinality"))
    count = F.count_distinct if exact else F.approx_count_distinct
    sizes = train.agg(*[count(F.col(c)).alias(c) for c in categorical])
    largest = F.greatest(*[F.col(c) for c in categorical]) if len(categorical) > 1 else F.col(categorical[0])
    return sizes.select(F.lit(len(categorical)).alias("n_categorical"), largest.alias("max_cardinality"))


def first_presence(df: DataFrame, fields: Sequence[str], time_col: str) -> DataFrame:
    """First month each field is filled, and the missing rate before and from that month."""
    month = month_of(time_col)
    counts = df.groupBy(month.alias("month")).agg(F.count("*").alias("n"), *[F.count(F.col(f)).alias(f) for f in fields])
    long = counts.unpivot(["month", "n"], list(fields), "field", "filled")
    first = long.groupBy("field").agg(F.min(F.when(F.col("filled") > 0, F.col("month"))).alias("first_month"))
    joined = long.join(broadcast_bounded(first, len(fields), 64), "field")
    later = F.col("month") >= F.col("first_month")
    rate = lambda cond: 1 - F.try_divide(F.sum(F.when(cond, F.col("filled"))).cast("double"), F.sum(F.when(cond, F.col("n"))))
    return joined.groupBy("field").agg(
        F.max("first_month").alias("first_month"), F.count_if(~later).alias("months_before"), rate(later).alias("missing_from_first"),
    )


def build_splits(df: DataFrame, windows: Windows, valid_fraction: float, seed: int) -> DataFrame:
    """Time windows plus a random validation part; the usual entry point after labelling."""
    return valid_from_train(assign_time_split(df, windows), valid_fraction, seed)

