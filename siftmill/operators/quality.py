"""Profiling and data-quality detectors with recomputable numbers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.dates import month_of
from siftmill.operators.label import LabelRule, label_column
from siftmill.plans.distribution import long_buckets, numeric_long, quantile_points, text_long
from siftmill.plans.sizing import broadcast_bounded, broadcast_if_small
from siftmill.session import cut_lineage

DATE_NAME = r"year|month|day|date|time"
# Common placeholders for "unknown".
PLACEHOLDER_NUMBERS = (-1, 99, 999, 9999, 99999, 365243)
PLACEHOLDER_TEXTS = ("", "xna", "xap", "na", "n/a", "null", "none", "undefined", "unknown", "?")


def _numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame, examples: int = 5) -> DataFrame:
    """One row per column: type, missing rate, distinct values, smallest examples, min and max.

    Values are counted in long form, so all columns share one pre-aggregated shuffle. The
    example ranking is limited before its shuffle by the planner's group limit.
    """
    names = df.columns
    counts = text_long(df, names).groupBy("feature", "value").agg(F.count("*").alias("n"))
    stats = counts.groupBy("feature").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("_gone"), F.count("value").alias("n_unique"),
    )
    order = Window.partitionBy("feature").orderBy("value")
    first = counts.where("value is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= examples)
    shown = first.groupBy("feature").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda s: s["value"])).alias("examples"))
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "feature string, sql_type string")
    out = broadcast_bounded(types, len(names), 64).join(stats, "feature").join(broadcast_if_small(cut_lineage(shown)), "feature", "left")
    nums = _numeric_fields(df)
    if nums:
        items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`lo|{f}`").alias("min_value"), F.col(f"`hi|{f}`").alias("max_value")) for f in nums])
        aggs = [a for f in nums for a in (F.min(F.col(f).cast("double")).alias(f"lo|{f}"), F.max(F.col(f).cast("double")).alias(f"hi|{f}"))]
        span = df.agg(*aggs).select(F.explode(items).alias("p")).select("p.*")
        out = out.join(F.broadcast(span), "feature", "left")  # one row per numeric column
    else:
        out = out.withColumns({"min_value": F.lit(None).cast("double"), "max_value": F.lit(None).cast("double")})
    rate = F.try_divide(F.col("_gone").cast("double"), F.col("n_rows"))
    return out.select(F.col("feature").alias("column"), "sql_type", "n_rows", rate.alias("missing_rate"), "n_unique", "examples", "min_value", "max_value")


def date_candidates(df: DataFrame, patterns: Sequence[str] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MMM-yyyy", "MM/dd/yyyy")) -> DataFrame:
    """Columns named like a date, or text columns most of whose filled rows parse as dates."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    named = df.sparkSession.createDataFrame([(c, bool(re.search(DATE_NAME, c, re.I))) for c in df.columns], "column string, by_name boolean")
    if not texts:
        return named.select("column", "by_name", F.lit(None).cast("double").alias("parse_share"), F.col("by_name").alias("candidate"))
    values = text_long(df, texts).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    parsed = F.coalesce(*[F.try_to_timestamp(F.col("value"), F.lit(p)) for p in patterns])
    share = values.groupBy("feature").agg((F.sum(F.when(parsed.isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("parse_share"))
    out = named.join(broadcast_bounded(share.withColumnRenamed("feature", "column"), len(texts), 64), "column", "left")
    return out.withColumn("candidate", F.col("by_name") | F.coalesce(F.col("parse_share") > 0.9, F.lit(False)))


def label_candidates(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns holding exactly the two values 0 and 1."""
    fs = list(fields) if fields is not None else _numeric_fields(df)
    aggs = []
    for f in fs:
        v = F.col(f).cast("double")
        aggs += [F.count_if(v == 0).alias(f"z|{f}"), F.count_if(v == 1).alias(f"o|{f}"), F.count(v).alias(f"n|{f}")]
    items = F.array(*[F.struct(F.lit(f).alias("column"), F.col(f"`z|{f}`").alias("n_zero"), F.col(f"`o|{f}`").alias("n_one"), F.col(f"`n|{f}`").alias("n_filled")) for f in fs])
    long = df.agg(*aggs).select(F.explode(items).alias("p")).select("p.*")
    return long.where((F.col("n_zero") > 0) & (F.col("n_one") > 0) & (F.col("n_zero") + F.col("n_one") == F.col("n_filled")))


def top_values(df: DataFrame, fields: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column as ``(column, rank, value, n)``."""
    counts = text_long(df, fields).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("feature").alias("column"), "rank", "value", "n")


def column_stats(df: DataFrame, fields: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Numeric statistics per column: counts, extremes and how often they occur, 1/50/99 percentiles."""
    fs = list(fields)
    dist = numeric_long(df, fs).groupBy("feature", "value").agg(F.count("*").alias("n"))
    # Counts at the extremes: keep the count next to the value while aggregating.
    stats = dist.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("_gone"), F.count("value").alias("n_unique"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min_by("n", "value").alias("n_at_min"), F.max_by("n", "value").alias("n_at_max"),
    )
    points = quantile_points(dist.where("value is not null"), ["feature"], [0.01, 0.5, 0.99], long_buckets(df, fs, buckets))
    wide = points.groupBy("feature").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(("p1", "p50", "p99"))])
    out = stats.join(broadcast_bounded(wide, len(fs), 64), "feature", "left")
    return out.select(
        F.col("feature").alias("column"), "n", (F.col("_gone").cast("double") / F.col("n")).alias("missing_rate"), "n_unique",
        "min_value", "max_value", "p1", "p50", "p99", "n_at_min", "n_at_max",
    )


def sentinel_candidates(df: DataFrame, fields: Sequence[str], share: float = 0.005, gap_iqr: float = 1.5, buckets: int | None = None) -> DataFrame:
    """Numeric values that look like placeholders.

    A value qualifies when it is the smallest or largest of its column, holds at least ``share``
    of the filled rows, and either lies ``gap_iqr`` interquartile ranges away from its neighbour
    or is a well-known placeholder number.
    """
    fs = list(fields)
    dist = numeric_long(df, fs).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    total = dist.groupBy("feature").agg(F.sum("n").alias("_all"))
    points = quantile_points(dist, ["feature"], [0.25, 0.75], long_buckets(df, fs, buckets))
    iqr = points.groupBy("feature").agg((F.max(F.when(F.col("i") == 1, F.col("q"))) - F.max(F.when(F.col("i") == 0, F.col("q")))).alias("_iqr"))
    ends = []
    for side, order in (("min", F.col("value").asc()), ("max", F.col("value").desc())):
        w = Window.partitionBy("feature").orderBy(order)
        two = dist.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
        ends.append(two.groupBy("feature").agg(
            F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("_r") == 1, F.col("n"))).alias("n"),
            F.max(F.when(F.col("_r") == 2, F.col("value"))).alias("_next"),
        ).withColumn("side", F.lit(side)))
    cand = ends[0].unionByName(ends[1])
    facts = total.join(iqr, "feature")
    out = cand.join(broadcast_bounded(facts, len(fs), 64), "feature")
    gap = F.abs(F.col("_next") - F.col("value"))
    often = F.col("n") / F.col("_all")
    known = F.col("value").isin(*[float(v) for v in PLACEHOLDER_NUMBERS])
    return out.where((often >= share) & F.col("_next").isNotNull() & ((gap >= gap_iqr * F.col("_iqr")) | known)).select(
        F.col("feature").alias("column"), "side", "value", "n", often.alias("share"), gap.alias("gap"), known.alias("known")
    )


def placeholder_texts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Text values that usually mean "unknown", including dates in 1900."""
    counts = text_long(df, fields).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    plain = F.lower(F.trim("value"))
    hit = plain.isin(*PLACEHOLDER_TEXTS) | F.col("value").rlike(r"^[A-Za-z]{3}-1900$|^1900-01-01")
    return counts.where(hit).select(F.col("feature").alias("column"), "value", "n")


#: A value in more than this share of the rows is one of at most 1 / share and is broadcast.
HOT_ROWS = 1e-3


def repeated_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in more than one row.

    Counts are combined before their shuffle. Rows of very frequent keys are picked by a broadcast of
    these few and stay where they are; only the other rows may be shuffled to meet their keys.
    """
    total = df.count()
    again = cut_lineage(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"))
    hot = F.broadcast(again.where(F.col("_n") > HOT_ROWS * total).select(key))  # at most 1 / HOT_ROWS rows
    rare = broadcast_if_small(cut_lineage(again.where(F.col("_n") <= HOT_ROWS * total).select(key)))
    return df.join(hot, key, "left_semi").unionByName(df.join(hot, key, "left_anti").join(rare, key, "left_semi"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(n_duplicates, n_groups)``: surplus copies of fully identical rows.

    Only row hashes are counted first; whole rows are compared for the hashes that repeat, and equal
    ones are combined before they are shuffled, so a row repeated in a third of the table is one row
    of each input partition.
    """
    cols = df.columns
    hashed = df.withColumn("_h", F.xxhash64(*cols))
    same = repeated_rows(hashed, "_h").groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1")
    return same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"), F.count("*").alias("n_groups"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, n_versions)`` for keys that occur with different content; exact copies do not count."""
    return repeated_rows(df, key).distinct().groupBy(key).agg(F.count("*").alias("n_versions")).where("n_versions > 1")


def normal_form(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def category_variants(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(column, canonical, variant, n)`` for categories written in more than one way."""
    counts = text_long(df, fields).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    named = counts.select(F.col("feature").alias("column"), normal_form(F.col("value")).alias("canonical"), F.col("value").alias("variant"), "n")
    several = named.groupBy("column", "canonical").agg(F.count("*").alias("_k")).where("_k > 1")
    return named.join(several.select("column", "canonical"), ["column", "canonical"], "left_semi")


def missing_months(df: DataFrame, time_col: str) -> DataFrame:
    """Calendar months between the first and the last one that have no rows."""
    seen = df.where(F.col(time_col).isNotNull()).groupBy(F.trunc(F.col(time_col).cast("date"), "month").alias("m")).agg(F.count("*").alias("n"))
    span = seen.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    return every.join(seen, "m", "left_anti").select(month_of("m").alias("month"))


def after_cutoff(df: DataFrame, relative_fields: Sequence[str], cutoff: int = 0) -> DataFrame:
    """Rows dated after the observation point, per relative time field."""
    aggs = [F.count("*").alias("_n"), *[F.count_if(F.col(f) > cutoff).alias(f) for f in relative_fields]]
    long = df.agg(*aggs).unpivot(["_n"], list(relative_fields), "field", "n_after")
    return long.select("field", F.col("_n").alias("n_rows"), "n_after", F.try_divide(F.col("n_after").cast("double"), F.col("_n")).alias("share"))


def in_record_after_cutoff(df: DataFrame, time_field: str, date_fields: Sequence[str]) -> DataFrame:
    """Records that are in the past themselves but carry a field from after the cutoff."""
    return after_cutoff(df.where(F.col(time_field) <= 0), date_fields)


def after_observation(child: DataFrame, rows: DataFrame, key: str, event_time: str, obs: str) -> DataFrame:
    """Same check with absolute times: detail rows later than their main row's observation time."""
    joined = child.join(rows.select(key, obs), key)
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col(event_time) > F.col(obs)).alias("n_after"))


def alerts(df: DataFrame, fields: Sequence[str], missing_max: float = 0.5, zeros_max: float = 0.5) -> DataFrame:
    """Basic column alerts: many missing, many zeros, constant, all unique."""
    dist = numeric_long(df, fields).groupBy("feature", "value").agg(F.count("*").alias("n"))
    s = dist.groupBy("feature").agg(
        F.sum("n").alias("_all"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("_gone"),
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("_zero"), F.count("value").alias("_k"), F.max("n").alias("_top"),
    )
    gone, zero = F.col("_gone").cast("double") / F.col("_all"), F.col("_zero").cast("double") / F.col("_all")
    codes = F.array_compact(F.array(
        F.when(gone > missing_max, "missing"), F.when(zero > zeros_max, "zeros"), F.when(F.col("_k") <= 1, "constant"),
        F.when((F.col("_k") == F.col("_all")) & (F.col("_top") == 1), "unique"),
    ))
    return s.select(F.col("feature").alias("column"), gone.alias("missing_share"), zero.alias("zero_share"), F.col("_k").alias("n_unique"), F.concat_ws(",", codes).alias("alerts"))


def post_outcome_fields(scan: DataFrame) -> DataFrame:
    """Suspicious fields of a leak scan with the reasons that apply."""
    reasons = F.concat_ws(",", F.array_compact(F.array(
        F.when(F.col("unavailable"), "availability"), F.when(F.col("name_hit"), "name_pattern"), F.when(F.col("suspect") & ~F.col("unavailable") & ~F.col("name_hit"), "single_feature_auc"),
    )))
    return scan.where("suspect").select(F.col("feature").alias("column"), reasons.alias("reasons"), "auc")


def score_findings(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """How many known issues were found.

    A finding matches an answer on table and column; without a column it must be about
    duplicates. Optional answers never lower the rate; a wrong finding counts once per column.
    """
    key = ["table", "column"]
    text = lambda df: df.withColumn("column", F.coalesce("column", F.lit("")))
    a, f = text(answers), text(findings)
    usable = f.where((F.col("column") != "") | F.lower("kind").contains("dup"))
    keys = usable.select(*key).distinct().withColumn("_hit", F.lit(True))
    marked = a.join(keys, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    required = ~F.coalesce(F.col("optional"), F.lit(False))
    must = F.coalesce(F.col("must_find"), F.lit(False))
    base = marked.agg(
        F.count_if(required).alias("n_answers"), F.count_if(required & F.col("_hit")).alias("n_found"),
        F.coalesce(F.bool_and(~must | F.col("_hit")), F.lit(True)).alias("must_find_ok"),
    )
    good = usable.select(*key).distinct().join(a.select(*key).distinct(), key, "left_semi")
    # A finding is wrong when its key has no answer, or when it is not usable at all.
    hit_keys = good.withColumn("_ok", F.lit(True))
    wrong = f.withColumn("_usable", (F.col("column") != "") | F.lower("kind").contains("dup")).join(hit_keys, key, "left")
    wrong = wrong.where(~(F.col("_usable") & F.coalesce("_ok", F.lit(False)))).select(*key).distinct().agg(F.count("*").alias("n_not_problems"))
    rate = F.when(F.col("n_answers") > 0, F.col("n_found") / F.col("n_answers")).otherwise(1.0)
    return base.join(F.broadcast(wrong)).select("n_answers", "n_found", rate.alias("found_rate"), "must_find_ok", "n_not_problems")  # one row each


def missed_answers(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """Required answers without a usable finding on the same table and column."""
    f = findings.where(F.col("column").isNotNull() | F.lower("kind").contains("dup")).select(F.col("table").alias("t"), F.coalesce("column", F.lit("")).alias("c")).distinct()
    a = answers.where(~F.coalesce(F.col("optional"), F.lit(False)))
    return a.join(f, (F.col("table") == F.col("t")) & (F.coalesce("column", F.lit("")) == F.col("c")), "left_anti")


def target_definitions(df: DataFrame, rules: Mapping[str, LabelRule], time_col: str) -> DataFrame:
    """Rows, positive rate and usable time range of every candidate label definition, in one pass."""
    structs = []
    aggs = []
    for i, (name, rule) in enumerate(rules.items()):
        y = label_column(rule)
        aggs += [F.count(y).alias(f"n{i}"), F.avg(y.cast("double")).alias(f"r{i}"), F.min(F.when(y.isNotNull(), F.col(time_col))).alias(f"lo{i}"), F.max(F.when(y.isNotNull(), F.col(time_col))).alias(f"hi{i}")]
        structs.append(F.struct(F.lit(name).alias("definition"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("bad_rate"), month_of(f"lo{i}").alias("first_month"), month_of(f"hi{i}").alias("last_month")))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("d")).select("d.*")


def remedy_impact(df: DataFrame, label: str, field: str, remedies: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Rows kept, positive rate and missing rate under each way of handling an issue.

    ``remedies`` maps a name to ``(keep row, new value of the field)``; all of them share one pass.
    """
    aggs, structs = [], []
    every = {"as_is": (F.lit(True), F.col(field)), **remedies}
    for i, (name, (keep, value)) in enumerate(every.items()):
        aggs += [F.count_if(keep).alias(f"n{i}"), F.avg(F.when(keep, F.col(label).cast("double"))).alias(f"r{i}"), F.avg(F.when(keep, value.isNull().cast("double"))).alias(f"m{i}")]
        structs.append(F.struct(F.lit(name).alias("remedy"), F.col(f"n{i}").alias("n_rows"), F.col(f"r{i}").alias("bad_rate"), F.col(f"m{i}").alias("missing_rate")))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("d")).select("d.*")
