"""Labels, row filters, sentinels, derived columns and type normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.columns import ID, LABEL
from siftmill.functions.text import identifiers
from siftmill.session import cut_lineage


@dataclass(frozen=True)
class LabelRule:
    """Status values that mean 1 and 0; anything else is unlabelled. ``column`` alone = a 0/1 column."""

    column: str
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class SentinelRule:
    """A value that stands for "missing" in the given fields."""

    value: object
    fields: tuple[str, ...] = field(default_factory=tuple)


def row_filter(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.where(condition)


def label_column(rule: LabelRule) -> Column:
    """1 / 0 / NULL; status values are compared as text."""
    c = F.col(rule.column)
    if not rule.positive and not rule.negative:
        return c
    text = c.cast("string")
    return F.when(text.isin(*rule.positive), 1).when(text.isin(*rule.negative), 0)


def with_label(df: DataFrame, rule: LabelRule) -> DataFrame:
    return df.withColumn(LABEL, label_column(rule).cast("int"))


def drop_unlabelled(df: DataFrame) -> DataFrame:
    """Call after history windows: those must see unlabelled rows too."""
    return df.where(F.col(LABEL).isNotNull())


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """The entity key as row id, or generated ids.

    Generated ids depend on the layout of the data, so they are written out once and every
    later step reads the written ones.
    """
    if key is not None:
        return df.withColumn(ID, F.col(key))
    return cut_lineage(df.withColumn(ID, F.monotonically_increasing_id()))


def sentinels_to_null(df: DataFrame, rules: Sequence[SentinelRule], flags: bool = True) -> DataFrame:
    """Placeholder values become NULL; the main table also gets ``<field>__is_sentinel`` flags."""
    cleaned, marks = {}, {}
    for rule in rules:
        for f in (f for f in rule.fields if f in df.columns):
            hit = F.col(f) == F.lit(rule.value)
            cleaned[f] = F.when(hit, None).otherwise(F.col(f))
            marks[f"{f}__is_sentinel"] = hit.cast("int")
    return df.withColumns({**cleaned, **(marks if flags else {})}) if cleaned else df


def dependency_order(expressions: Mapping[str, str]) -> list[str]:
    """Names sorted so that every expression comes after the ones it uses."""
    done: list[str] = []

    def visit(name: str, path: tuple[str, ...]):
        if name in path:
            raise ValueError(f"derived columns refer to each other in a circle: {' -> '.join((*path, name))}")
        if name in done:
            return
        for used in identifiers(expressions[name]):
            if used in expressions and used != name:
                visit(used, (*path, name))
        done.append(name)

    for name in expressions:
        visit(name, ())
    return done


def derive(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Row expressions that may use each other; each result is a double, NULL when it cannot be cast.

    Expressions read raw columns: apply :func:`sentinels_to_null` afterwards.
    """
    names = dependency_order(expressions)
    out = df
    for name in names:
        out = out.withColumn(name, F.expr(expressions[name]))
    doubles = {n: F.expr(f"try_cast(`{n}` as double)") for n in names}
    return out.withColumns(doubles) if doubles else out


def normalize_numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Booleans and integers become doubles, NaN becomes NULL; other types stay."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for f in features:
        if isinstance(kinds[f], T.BooleanType):
            out[f] = F.col(f).cast("int").cast("double")
        elif isinstance(kinds[f], (T.IntegralType, T.DecimalType)):
            out[f] = F.col(f).cast("double")
        elif isinstance(kinds[f], T.FractionalType):
            out[f] = F.nanvl(F.col(f), F.lit(None)).cast("double")
    return df.withColumns(out) if out else df


def normalized_types(df: DataFrame, features: Sequence[str]) -> dict[str, str]:
    """Original type of every column that :func:`normalize_numeric` changes."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in features and isinstance(f.dataType, (T.BooleanType, T.IntegralType, T.DecimalType))}
