"""Splits, time checks and history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, SPLIT
from siftmill.functions import dates
from siftmill.operators import history, splits
from siftmill.queries import bindings as b
from siftmill.queries.base import query, r, rounded, table, union_all

@query("time_split", "T1", f"WITH {b.CTE_SPLITS} SELECT _row_id, s0 AS split FROM ranked")
def time_split(spark, sf):
    return splits.assign_time_split(b.planted(spark, sf), b.WINDOWS).select(ID, SPLIT)


@query("validation_part", "T2", f"WITH {b.CTE_SPLITS} SELECT _row_id, split FROM splits")
def validation_part(spark, sf):
    built = splits.build_splits(b.planted(spark, sf), b.WINDOWS, b.VALID, b.SEED)
    return built.select(ID, SPLIT)


FRACTIONS = {"train": 0.5, "valid": 0.2, "oot_dev": 0.15, "holdout": 0.1}


@query("random_split", "T3", f"""
WITH {b.CTE_MAIN}, d AS (
  SELECT _row_id, _label, row_number() OVER (PARTITION BY _label ORDER BY md5('42|' || CAST(_row_id AS VARCHAR)), _row_id) AS rk, count(*) OVER (PARTITION BY _label) AS n
  FROM main WHERE _label IS NOT NULL),
e AS (SELECT *, floor(n * CAST(0.5 AS DOUBLE)) AS a, floor(n * CAST(0.2 AS DOUBLE)) AS b, floor(n * CAST(0.15 AS DOUBLE)) AS c, floor(n * CAST(0.1 AS DOUBLE)) AS d FROM d)
SELECT _row_id, _label, CASE WHEN rk <= a THEN 'train' WHEN rk <= a + b THEN 'valid' WHEN rk <= a + b + c THEN 'oot_dev' ELSE 'holdout' END AS split
FROM e WHERE rk <= a + b + c + d""")
def random_split(spark, sf):
    return splits.assign_random_split(b.main(spark, sf), FRACTIONS, 42).select(ID, LABEL, SPLIT)


@query("maturity_check", "T4", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, {r("avg(CASE WHEN o_orderstatus IN ('P') THEN 1.0 ELSE 0.0 END)")} AS share,
       avg(CASE WHEN o_orderstatus IN ('P') THEN CAST(1 AS DOUBLE) ELSE 0 END) > 0.33 AS data_fatal
FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-01' AND '2000-12' GROUP BY 1""")
def maturity_check(spark, sf):
    return rounded(splits.maturity_check(table(spark, sf, "orders"), "o_orderstatus", ["P"], "o_orderdate", 0.33, ("1995-01", "2000-12")), 6, "share")


@query("split_counts", "T5", f"WITH {b.CTE_SPLITS} SELECT split, count(*) AS n, {r('avg(_label)')} AS bad_rate FROM splits GROUP BY 1")
def split_counts(spark, sf):
    return rounded(splits.split_counts(b.splits(spark, sf)), 6, "bad_rate")


@query("missing_rate_shift", "T6", f"""
WITH {b.CTE_SPLITS}, m AS (
  SELECT f.feature, split, avg(CASE WHEN (CASE f.feature WHEN 'qty_sum' THEN qty_sum WHEN 'sparse' THEN sparse WHEN 'half' THEN half ELSE shifted END) IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate
  FROM (SELECT *, CASE WHEN split = 'oot_dev' AND h < 40 THEN NULL ELSE total END AS shifted FROM splits) s, (VALUES ('qty_sum'), ('sparse'), ('half'), ('shifted')) AS f(feature)
  WHERE split IN ('train', 'oot_dev') GROUP BY 1, 2)
SELECT a.feature, {r('a.rate')} AS rate_left, {r('b.rate')} AS rate_right, {r('abs(a.rate - b.rate)')} AS shift
FROM m a JOIN m b ON a.feature = b.feature AND a.split = 'train' AND b.split = 'oot_dev' WHERE abs(a.rate - b.rate) > 0.2""")
def missing_rate_shift(spark, sf):
    df = b.splits(spark, sf).withColumn("shifted", F.when(~((F.col(SPLIT) == "oot_dev") & (F.col("h") < 40)), F.col("total")))
    return rounded(splits.missing_rate_shift(df, ["qty_sum", "sparse", "half", "shifted"], 0.2), 6, "rate_left", "rate_right", "shift")


@query("label_crosstab", "T7", f"SELECT o_orderpriority AS v, {b.LABEL_SQL} AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def label_crosstab(spark, sf):
    return splits.label_crosstab(table(spark, sf, "orders"), "o_orderpriority", b.STATUS)


@query("date_distances", "T8", """
SELECT event_id, (2024 - year(ts)) * 12 + (3 - month(ts)) AS months_before, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0) AS BIGINT) AS days_from_ref,
       CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS days_from_epoch FROM events""")
def date_distances(spark, sf):
    ref = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        "event_id", dates.months_before("ts", F.lit("2024-03-01").cast("date")).cast("long").alias("months_before"),
        dates.days_from("ts", ref).alias("days_from_ref"), dates.days_from("ts").alias("days_from_epoch"),
    )


@query("time_expression_share", "T9", f"""
WITH t AS (SELECT strftime(o_orderdate, '%b-%Y') AS txt, o_orderpriority, o_orderdate FROM orders),
e AS (SELECT 'month_text' AS expression, count(*) AS n_rows, count(try_strptime(txt, '%b-%Y')) AS n_ok FROM t
      UNION ALL SELECT 'priority_text', count(*), count(try_strptime(o_orderpriority, '%Y-%m-%d')) FROM t
      UNION ALL SELECT 'first_half', count(*), count(CASE WHEN month(o_orderdate) <= 6 THEN o_orderdate END) FROM t)
SELECT expression, n_rows, n_ok, {r('CAST(n_ok AS DOUBLE) / n_rows')} AS share, CAST(n_ok AS DOUBLE) / n_rows >= 0.99 AS ok FROM e""")
def time_expression_share(spark, sf):
    df = table(spark, sf, "orders").withColumn("txt", F.date_format("o_orderdate", "MMM-yyyy"))
    return rounded(splits.time_expression_share(df, {
        "month_text": dates.parse_time("txt", "MMM-yyyy"), "priority_text": dates.parse_time("o_orderpriority", "yyyy-MM-dd"),
        "first_half": F.when(F.month("o_orderdate") <= 6, F.col("o_orderdate")),
    }), 6, "share")


@query("date_field_share", "T9", f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 4 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS partly FROM orders),
e AS (SELECT 'day' AS field, count(day) AS n_filled, count(TRY_CAST(day AS DATE)) AS n_ok FROM t UNION ALL SELECT 'partly', count(partly), count(TRY_CAST(partly AS DATE)) FROM t)
SELECT field, n_filled, n_ok, {r('CAST(n_ok AS DOUBLE) / n_filled')} AS share, CAST(n_ok AS DOUBLE) / n_filled >= 0.99 AS ok FROM e""")
def date_field_share(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    df = table(spark, sf, "orders").withColumns({"day": day, "partly": F.when(F.col("o_custkey") % 4 == 0, "n/a").otherwise(day)})
    return rounded(splits.date_field_share(df, ["day", "partly"]), 6, "share")


@query("window_classes", "T10", f"""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, {b.LABEL_SQL} AS y FROM orders),
w("window", lo, hi) AS (VALUES ('train_valid', '1995-01', '1998-12'), ('oot_dev', '1999-01', '1999-12'), ('holdout', '2002-01', '2002-08'))
SELECT "window", count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0 AS ok
FROM w LEFT JOIN m ON month BETWEEN lo AND hi GROUP BY 1""")
def window_classes(spark, sf):
    from siftmill.operators.label import label_column

    windows = {**b.WINDOWS, "holdout": ("2002-01", "2002-08")}
    return splits.window_classes(table(spark, sf, "orders"), "o_orderdate", windows, label_column(b.STATUS))


@query("dataset_fingerprint", "T11", f"""
WITH {b.CTE_SPLITS} SELECT count(*) AS n_samples, 4 AS n_features, {r('avg(_label)')} AS bad_rate,
  {r('(avg(CASE WHEN total IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN qty_sum IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN half IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN cat IS NULL THEN 1.0 ELSE 0 END)) / 4')} AS missing_rate,
  CAST(year(max(_split_time)) * 12 + month(max(_split_time)) - year(min(_split_time)) * 12 - month(min(_split_time)) AS INTEGER) AS time_span_months
FROM splits WHERE split = 'train'""")
def dataset_fingerprint(spark, sf):
    train = b.splits(spark, sf).where(F.col(SPLIT) == "train")
    return rounded(splits.dataset_fingerprint(train, ["total", "qty_sum", "half", "cat"]), 6, "bad_rate", "missing_rate")


@query("modeling_profile", "T12,A2", "SELECT 3 AS n_categorical, greatest(count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_suppkey)) AS max_cardinality FROM lineitem")
def modeling_profile(spark, sf):
    return splits.modeling_profile(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


@query("first_presence", "T13", f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN year(o_orderdate) >= 1997 AND o_custkey % 10 > 0 THEN o_totalprice END AS late, o_custkey FROM orders),
f AS (SELECT 'late' AS field, min(CASE WHEN late IS NOT NULL THEN month END) AS first_month FROM t UNION ALL SELECT 'o_custkey', min(CASE WHEN o_custkey IS NOT NULL THEN month END) FROM t)
SELECT field, first_month, count(DISTINCT CASE WHEN month < first_month THEN month END) AS months_before,
       {r("avg(CASE WHEN month >= first_month THEN CASE WHEN (CASE field WHEN 'late' THEN late ELSE o_custkey END) IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END END)")} AS missing_from_first
FROM f, t GROUP BY 1, 2""")
def first_presence(spark, sf):
    df = table(spark, sf, "orders").withColumn("late", F.when((F.year("o_orderdate") >= 1997) & (F.col("o_custkey") % 10 > 0), F.col("o_totalprice")))
    return rounded(splits.first_presence(df, ["late", "o_custkey"], "o_orderdate"), 6, "missing_from_first")


# ---- history --------------------------------------------------------------------------------

@query("history_by_entity", "HF1,HF2", f"""
SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, {r('avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS value_mean3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def history_by_entity(spark, sf):
    out = history.history_features(table(spark, sf, "events"), {"value": {"lags": [1, 2], "means": [3]}}, ["ts", "event_id"], ["user_id"])
    return rounded(out.select("event_id", "value_lag1", "value_lag2", "value_mean3"), 6, "value_mean3")


@query("history_by_entity_cut", "HF1,HF2", f"""
SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, {r('avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS value_mean3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def history_by_entity_cut(spark, sf):
    """The same with every entity's series cut into buckets and chunks."""
    out = history.history_features(table(spark, sf, "events"), {"value": {"lags": [1, 2], "means": [3]}}, ["ts", "event_id"], ["user_id"], buckets=8, chunk_rows=16)
    return rounded(out.select("event_id", "value_lag1", "value_lag2", "value_mean3"), 6, "value_mean3")


@query("history_global", "HF3", f"""
SELECT event_id, lag(value, 2) OVER w AS value_lag2, {r('avg(value) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)')} AS value_mean48,
       lag(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 0 END, 1) OVER w AS event_type_lag1
FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def history_global(spark, sf):
    from siftmill.operators.label import LabelRule

    rule = LabelRule("event_type", ("purchase",), ("click",))
    out = history.history_features(table(spark, sf, "events"), {"value": {"lags": [2], "means": [48]}, "event_type": {"lags": [1]}}, ["ts", "event_id"], label=rule, buckets=16, chunk_rows=500)
    return rounded(out.select("event_id", "value_lag2", "value_mean48", F.col("event_type_lag1").cast("int").alias("event_type_lag1")), 6, "value_mean48")


@query("history_trusted", "HF4", "SELECT name, trusted, (SELECT count(*) FROM events) AS n_rows FROM (VALUES ('value', FALSE), ('value_lag1', TRUE), ('value_mean3', TRUE)) AS t(name, trusted)")
def history_trusted(spark, sf):
    spec = {"value": {"lags": [1], "means": [3]}}
    out = history.history_features(table(spark, sf, "events"), spec, ["ts", "event_id"], ["user_id"])
    marked = history.mark_history(out, history.history_names(spec))
    names = [n for n in ("value", "value_lag1", "value_mean3")]
    flags = {f.name: f.metadata.get("availability") == "history" for f in marked.schema.fields}
    return union_all([marked.agg(F.lit(n).alias("name"), F.lit(flags[n]).alias("trusted"), F.count("*").alias("n_rows")) for n in names])

