"""Model inputs: medians for missing numbers, codes and target statistics for categories.

Everything is fitted with joins and aggregates; the driver holds one number per feature. Levels
get dense alphabetical codes from their position in the ordered level table. A feature with more
levels than trees can split on is given as the smoothed event rate of its level instead, and a
training row's own fold is left out of that rate, so no row sees its own label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, OBS, SPLIT
from siftmill.functions.dates import months_before
from siftmill.plans.distribution import long_buckets, numeric_long, quantile_points, text_long
from siftmill.plans.ordered import plan_buckets, row_positions
from siftmill.plans.skew import hot_split_join
from siftmill.session import cut_lineage

#: Folds of the training rows by a hash of their id, and rows at the overall rate that a level is credited with.
FOLDS, CREDIT = 5, 20.0
#: A level with more than this share of the rows is joined by broadcast; at most 1 / share exist per feature.
HOT = 1e-3
#: Levels above these bytes, a level taken for so many, are joined by a sort: the planner would judge the table
#: by its size on disk, where it is packed, and send all of it through the driver.
SENT_BYTES, LEVEL_BYTES = 8 << 20, 256


@dataclass(frozen=True)
class Inputs:
    """Feature columns by kind. Date fields are text and become months before the observation."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    date_pattern: str = "MMM-yyyy"

    @property
    def numbers(self) -> list[str]:
        return [*self.numeric, *self.dates]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.dates, *self.categorical]


def prepare(df: DataFrame, inputs: Inputs) -> DataFrame:
    """Dates as months before the observation point, numbers as doubles."""
    out = {c: months_before(F.try_to_timestamp(F.col(c), F.lit(inputs.date_pattern)), OBS).cast("double") for c in inputs.dates}
    out.update({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in inputs.numeric})
    return df.withColumns(out) if out else df


def fold_of(key: str = ID) -> Column:
    """Fold of a row by its id: the same in every run and layout."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("fold|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % FOLDS


def medians(rows: DataFrame, features: list[str], buckets: int | None = None) -> dict[str, float]:
    """Exact interpolated median of every feature; 0 where it has no value at all."""
    if not features:
        return {}
    long = numeric_long(rows, features).where("value is not null")
    dist = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    found = {r["feature"]: r["q"] for r in quantile_points(dist, ["feature"], [0.5], long_buckets(rows, features, buckets)).collect()}  # one row a feature
    return {f: float(found.get(f, 0.0)) for f in features}


def level_table(rows: DataFrame, features: list[str], label: str = LABEL, buckets: int | None = None) -> DataFrame:
    """``feature, value, code, n, n0.., pos0..``: every level with its place in the alphabet, its rows
    and, per fold, its labelled and positive rows."""
    keyed = rows.withColumns({"_fold": fold_of(), "_y": F.col(label)})
    long = text_long(keyed, features, ["_fold", "_y"]).where("value is not null")
    of = lambda k: F.col("_fold") == k
    folds = [F.count(F.when(of(k), F.col("_y"))).alias(f"n{k}") for k in range(FOLDS)]
    folds += [F.count(F.when(of(k) & (F.col("_y") == 1), 1)).alias(f"pos{k}") for k in range(FOLDS)]
    levels = cut_lineage(long.groupBy("feature", "value").agg(F.count("*").alias("n"), *folds))
    return cut_lineage(row_positions(levels, ["feature"], ["value"], plan_buckets(levels, "value", buckets), "code"))


def level_codes(df: DataFrame, features: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` with ``_code_<feature>``: the place of each value among the column's values in the alphabet."""
    if not features:
        return df
    n = df.count()
    long = text_long(df, features).where("value is not null")
    levels = cut_lineage(long.groupBy("feature", "value").agg(F.count("*").alias("n")))
    codes = cut_lineage(row_positions(levels, ["feature"], ["value"], plan_buckets(levels, "value", buckets), "code"))
    for c in features:
        own = codes.where(F.col("feature") == c).select(F.col("value").alias(f"_l_{c}"), F.col("code").cast("double").alias(f"_code_{c}"), (F.col("n") > HOT * n).alias("_often"))
        df = hot_split_join(df.withColumn(f"_l_{c}", F.col(c).cast("string")), own, [f"_l_{c}"], F.col("_often"), int(1 / HOT), ID).drop(f"_l_{c}", "_often")
    return df


@dataclass(frozen=True)
class Encoder:
    """Fitted inputs; ``features`` is the assembled vector column."""

    inputs: Inputs
    medians: dict[str, float]
    levels: DataFrame | None
    sizes: dict[str, int]
    n: int
    prior: float
    max_codes: int

    def rated(self, feature: str) -> bool:
        """Whether the feature has too many levels for codes; unseen levels need one more."""
        return self.sizes.get(feature, 0) + 1 > self.max_codes

    @property
    def columns(self) -> list[str]:
        coded = [f"{c}__rate" if self.rated(c) else f"{c}__code" for c in self.inputs.categorical]
        return [f"{c}__filled" for c in self.inputs.numbers] + coded

    def transform(self, df: DataFrame, own: Column | None = None) -> DataFrame:
        """``df`` with one model column per input and ``features``.

        ``own`` marks training rows, whose fold is left out of a level's rate; by default the rows of
        the split "train". A level never seen has the code after the last one, and the overall rate.
        """
        if own is None:
            own = F.col(SPLIT) == "train" if SPLIT in df.columns else F.lit(False)
        out = prepare(df, self.inputs)
        filled = {f"{c}__filled": F.coalesce(F.col(c), F.lit(self.medians[c])) for c in self.inputs.numbers}
        out = out.withColumns(filled) if filled else out
        out = out.withColumns({"_own": F.coalesce(own, F.lit(False)), "_fold": fold_of()}) if self.inputs.categorical else out
        for c in self.inputs.categorical:
            out = self._attach(out, c)
        out = out.drop("_own", "_fold")
        return VectorAssembler(inputCols=self.columns, outputCol="features", handleInvalid="keep").transform(out)

    def _attach(self, df: DataFrame, c: str) -> DataFrame:
        own = self.levels.where(F.col("feature") == c)
        if self.rated(c):
            total = sum(F.col(f"n{k}") for k in range(FOLDS)), sum(F.col(f"pos{k}") for k in range(FOLDS))
            told = F.array(F.struct(total[0].alias("n"), total[1].alias("pos")), *[F.struct((total[0] - F.col(f"n{k}")).alias("n"), (total[1] - F.col(f"pos{k}")).alias("pos")) for k in range(FOLDS)])
        else:
            told = F.col("code").cast("double")
        lookup = own.select(F.col("value").alias(f"_l_{c}"), told.alias(f"_t_{c}"), (F.col("n") > HOT * self.n).alias(f"_often_{c}"))
        if self.sizes.get(c, 0) * LEVEL_BYTES > SENT_BYTES:
            lookup = lookup.hint("merge")
        out = hot_split_join(df.withColumn(f"_l_{c}", F.col(c).cast("string")), lookup, [f"_l_{c}"], F.col(f"_often_{c}"), int(1 / HOT), ID)
        found = F.col(f"_t_{c}")
        if self.rated(c):
            side = F.get(found, F.when(F.col("_own"), F.col("_fold") + 1).otherwise(0).cast("int"))
            rate = (F.coalesce(side["pos"], F.lit(0)) + F.lit(CREDIT * self.prior)) / (F.coalesce(side["n"], F.lit(0)) + F.lit(CREDIT))
            made, meta = {f"{c}__rate": rate}, {}
        else:
            size = self.sizes.get(c, 0)
            made, meta = {f"{c}__code": F.coalesce(found, F.lit(float(size)))}, {f"{c}__code": {"ml_attr": {"type": "nominal", "num_vals": size + 1, "name": f"{c}__code"}}}
        out = out.withColumns(made).drop(f"_l_{c}", f"_t_{c}", f"_often_{c}")
        for name, attributes in meta.items():
            out = out.withMetadata(name, attributes)
        return out


def fit_encoder(train: DataFrame, inputs: Inputs, max_codes: int = 64, label: str = LABEL, buckets: int | None = None) -> Encoder:
    """Medians, levels and their rates frozen on the training rows.

    Categorical features with ``max_codes`` levels or more are encoded by rate.
    """
    rows = prepare(train, inputs)
    whole = rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col(label).isNotNull(), (F.col(label) == 1).cast("double"))).alias("prior")).first()
    levels, sizes = None, {}
    if inputs.categorical:
        levels = level_table(rows, list(inputs.categorical), label, buckets)
        sizes = {r["feature"]: r["count"] for r in levels.groupBy("feature").count().collect()}  # one row a feature
    return Encoder(inputs, medians(rows, inputs.numbers, buckets), levels, sizes, whole["n"], float(whole["prior"] or 0.0), max_codes)
