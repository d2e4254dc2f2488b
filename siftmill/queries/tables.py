"""Sources, labels, projections and column policy over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, OBS, SPLIT
from siftmill.operators import label as lab
from siftmill.operators import policy as pol
from siftmill.operators.label import LabelRule, SentinelRule
from siftmill.queries import bindings as b
from siftmill.queries.base import query, r, rounded, table, union_all
from siftmill.session import scratch_root
from siftmill.sources import eventlog, split_store, subset
from siftmill.sources import tables as src


def scratch(spark) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


@query("csv_typed_read", "IO1", f"""
SELECT o_orderstatus, count(*) AS n, count(NULLIF(o_orderpriority, '4-NOT SPECIFIED')) AS n_priority,
       {r('avg(o_totalprice)', 4)} AS avg_price, min(o_orderkey) AS min_key, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
FROM orders GROUP BY 1""")
def csv_typed_read(spark, sf):
    path = scratch(spark)
    table(spark, sf, "orders").write.option("header", True).csv(path)
    df = src.read_table(spark, path, ["NA", "4-NOT SPECIFIED"])
    out = df.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count("o_orderpriority").alias("n_priority"), F.avg("o_totalprice").alias("avg_price"),
        F.min("o_orderkey").alias("min_key"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"),
    )
    return rounded(out, 4, "avg_price")


@query("computed_aliases", "IO2", """
SELECT strftime(o_orderdate + to_days(30), '%Y-%m') AS due_month, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 250000) AS n_large
FROM orders GROUP BY 1""")
def computed_aliases(spark, sf):
    df = src.with_aliases(table(spark, sf, "orders"), {"due": "o_orderdate + make_dt_interval(30)", "large": "o_totalprice > 250000"})
    return df.groupBy(F.date_format("due", "yyyy-MM").alias("due_month")).agg(F.count("*").alias("n"), F.count_if("large").alias("n_large"))


@query("parquet_cache", "IO3", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1")
def parquet_cache(spark, sf):
    path = scratch(spark)
    src.cached_parquet(table(spark, sf, "lineitem"), path)
    again = src.cached_parquet(table(spark, sf, "lineitem").limit(0), path)  # the finished copy wins
    return again.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("splits_written", "IO4,T1,T2,T5", f"WITH {b.CTE_SPLITS} SELECT split, count(*) AS n, {r('avg(_label)')} AS bad_rate FROM splits GROUP BY 1")
def splits_written(spark, sf):
    store = split_store.SplitStore(spark, scratch(spark))
    store.write(b.splits(spark, sf))
    gate = split_store.FinalGate(store, "check")
    every = store.read_open().unionByName(store.read("holdout", gate).withColumn(SPLIT, F.lit("holdout")))
    return rounded(every.groupBy(SPLIT).agg(F.count("*").alias("n"), F.avg(F.col(LABEL).cast("double")).alias("bad_rate")), 6, "bad_rate")


@query("split_loaded", "IO5", f"WITH {b.CTE_SPLITS} SELECT _row_id, _label, signal, cat FROM splits WHERE split = 'oot_dev'")
def split_loaded(spark, sf):
    store = split_store.SplitStore(spark, scratch(spark))
    store.write(b.splits(spark, sf))
    return store.read("oot_dev").select(ID, LABEL, "signal", "cat")


@query("holdout_gate", "IO5,ML15", f"WITH {b.CTE_SPLITS} SELECT 'run-1' AS exp_id, count(*) AS n, {r('avg(_label)')} AS bad_rate FROM splits WHERE split = 'holdout'")
def holdout_gate(spark, sf):
    store = split_store.SplitStore(spark, scratch(spark))
    store.write(b.splits(spark, sf))
    gate = split_store.FinalGate(store, "task")
    measure = lambda rows: rows.agg(F.count("*").alias("n"), F.avg(F.col(LABEL).cast("double")).alias("bad_rate"))
    gate.run_once("run-1", measure)
    return rounded(gate.run_once("run-1", measure), 6, "bad_rate")


UNION_TABLES = {"orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(), "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split()}


@query("column_union", "IO6", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_filled FROM {t}" for t, cs in UNION_TABLES.items() for c in cs))
def column_union(spark, sf):
    frames = {t: table(spark, sf, t) for t in UNION_TABLES}
    names = src.column_union([f.columns for f in frames.values()])
    counts = [f.agg(*[F.count(c).alias(c) for c in f.columns]).unpivot([], f.columns, "column", "n_filled") for f in frames.values()]
    return union_all(counts).where(F.col("column").isin(*names))


@query("entity_subset", "IO7,J2,J3,L5", """
WITH ids AS (SELECT c_custkey FROM customer ORDER BY md5('7|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 200),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ids)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS "table", count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM ids
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM o
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM l""")
def entity_subset(spark, sf):
    got = subset.entity_subset(
        table(spark, sf, "customer"), "c_custkey", 200, 7, {"orders": (table(spark, sf, "orders"), "o_custkey")},
        {"lineitem": (table(spark, sf, "lineitem"), "l_orderkey", "orders", "o_orderkey")},
    )
    keys = {"main": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    count = lambda name, key: got[name].agg(F.lit(name.replace("main", "customer")).alias("table"), F.count("*").alias("n"), F.sum(key).alias("key_sum"))
    return union_all([count(name, key) for name, key in keys.items()])


@query("event_query", "IO8", f"WITH {b.CTE_LOG} SELECT id, task_id, ts, exp_id FROM log WHERE type = 'recorded' AND id > 100")
def event_query(spark, sf):
    path = scratch(spark)
    log = b.runlog(spark, sf)
    eventlog.append_events(log.where("id % 2 = 0"), path)
    eventlog.append_events(log.where("id % 2 = 1"), path)
    return eventlog.query_events(eventlog.read_events(spark, path), type="recorded", after_id=100).select("id", "task_id", "ts", "exp_id")


@query("report_json", "IO9", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def report_json(spark, sf):
    path = scratch(spark)
    src.write_report_json(table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("status string, n long").json(path)


# ---- labels and rows ------------------------------------------------------------------------

@query("label_counts", "P1,P2", f"SELECT {b.LABEL_SQL} AS y, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def label_counts(spark, sf):
    df = lab.with_label(lab.row_filter(table(spark, sf, "orders"), "o_totalprice > 100000"), b.STATUS)
    return df.groupBy(F.col(LABEL).alias("y")).agg(F.count("*").alias("n"))


@query("drop_unlabelled", "P3", f"""
WITH w AS (SELECT o_orderkey, {b.LABEL_SQL} AS y, lag({b.LABEL_SQL}, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
SELECT o_orderkey AS _row_id, y AS _label, prev FROM w WHERE y IS NOT NULL""")
def drop_unlabelled(spark, sf):
    from siftmill.operators.history import history_features

    df = lab.with_label(table(spark, sf, "orders").withColumn(ID, F.col("o_orderkey")), b.STATUS)
    hist = history_features(df, {"o_orderstatus": {"lags": [1]}}, ["o_orderdate", ID], ["o_custkey"], b.STATUS)
    return lab.drop_unlabelled(hist).select(ID, LABEL, F.col("o_orderstatus_lag1").cast("int").alias("prev"))


@query("row_ids", "P4", "SELECT count(*) AS n, count(*) AS n_ids FROM lineitem")
def row_ids(spark, sf):
    ids = lab.with_row_id(table(spark, sf, "lineitem"))
    return ids.groupBy(ID).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("n_ids"))


@query("sentinel_flags", "P5", """
SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS l_quantity,
       CAST(l_quantity = 50 AS INTEGER) AS l_quantity__is_sentinel FROM lineitem""")
def sentinel_flags(spark, sf):
    return lab.sentinels_to_null(table(spark, sf, "lineitem"), [SentinelRule(50.0, ("l_quantity",))]).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_quantity__is_sentinel")


@query("sentinel_child", "P6", f"SELECT l_returnflag, count(NULLIF(l_quantity, 50)) AS n_known, {r('avg(NULLIF(l_quantity, 50))')} AS avg_qty FROM lineitem GROUP BY 1")
def sentinel_child(spark, sf):
    df = lab.sentinels_to_null(table(spark, sf, "lineitem"), [SentinelRule(50.0, ("l_quantity",))], flags=False)
    return rounded(df.groupBy("l_returnflag").agg(F.count("l_quantity").alias("n_known"), F.avg("l_quantity").alias("avg_qty")), 6, "avg_qty")


@query("derived_columns", "P7", f"""
SELECT o_orderkey, CAST(o_totalprice / 1000 AS DOUBLE) AS thousands, {r('(o_totalprice / 1000) / NULLIF(o_custkey % 5, 0)', 9)} AS per_unit,
       CAST(CASE WHEN o_totalprice / 1000 > 250 THEN 1 ELSE 0 END AS DOUBLE) AS is_large FROM orders""")
def derived_columns(spark, sf):
    df = lab.derive(table(spark, sf, "orders"), {
        "is_large": "case when thousands > 250 then 1 else 0 end", "per_unit": "thousands / nullif(o_custkey % 5, 0)", "thousands": "o_totalprice / 1000",
    })
    return rounded(df.select("o_orderkey", "thousands", "per_unit", "is_large"), 9, "per_unit")


POLICY = pol.FieldPolicy(
    fields={
        "o_totalprice": {"availability": "application"}, "o_orderdate": {"availability": "application"}, "o_orderpriority": {"availability": "updated_until_event"},
        "o_custkey": {"availability": "meta"}, "o_comment": {"availability": "application"},
    },
    leakage_prefixes=("o_order",), incumbent=("o_custkey",), review=("o_totalprice",), unknown=("o_clerk",), patterns=("price$",), special=("o_orderstatus", "o_orderkey"),
)
POLICY_LINES = pol.FieldPolicy(
    fields={"l_quantity": {"availability": "application"}, "l_extendedprice": {"availability": "application"}, "l_discount": {"availability": "loan_terms"}, "l_tax": {"availability": "unknown"}, "l_shipdate": {"availability": "post_outcome"}},
    leakage=("l_linestatus",), leakage_prefixes=("l_ship",), meta=("l_linenumber",), compliance=("l_suppkey",), incumbent=("l_partkey",), patterns=("^l_ext",), special=("l_returnflag",),
)


@query("column_policy", "P8", """
WITH d("column", decision, reason) AS (VALUES
  ('l_orderkey', 'quarantine', ''), ('l_partkey', 'drop', 'incumbent'), ('l_suppkey', 'drop', 'compliance'), ('l_linenumber', 'drop', 'meta'),
  ('l_quantity', 'keep', ''), ('l_extendedprice', 'keep', ''), ('l_discount', 'keep', ''), ('l_tax', 'quarantine', ''),
  ('l_linestatus', 'drop', 'leakage'), ('l_shipdate', 'drop', 'leakage'))
SELECT d."column", d.decision, d.reason, (SELECT count(*) FROM lineitem) AS n_filled FROM d""")
def column_policy(spark, sf):
    df = table(spark, sf, "lineitem")
    return pol.decision_table(df, pol.column_policy(df.columns, POLICY_LINES))


@query("derived_availability", "P9", """
SELECT name, availability, too_strong, (SELECT count(*) FROM lineitem) AS n_rows FROM (VALUES
  ('net', 'loan_terms', FALSE), ('late', 'post_outcome', TRUE), ('mixed', 'post_outcome', FALSE), ('taxed', 'unknown', TRUE)) AS t(name, availability, too_strong)""")
def derived_availability(spark, sf):
    known = {k: dict(v) for k, v in POLICY_LINES.fields.items()}
    exprs = {"net": ("l_discount * l_extendedprice", None), "late": ("datediff(l_shipdate, date '1995-01-01')", "application"), "mixed": ("late + net", None), "taxed": ("l_tax * l_quantity", "application")}
    rows = pol.availability_report(spark, exprs, known)
    df = table(spark, sf, "lineitem").withColumns({n: F.expr(e) for n, (e, _) in exprs.items() if n != "mixed"}).withColumn("mixed", F.expr("late + net"))
    counts = df.agg(*[F.count(n).alias(n) for n in exprs]).unpivot([], list(exprs), "name", "n_rows")
    return spark.createDataFrame(rows, "name string, availability string, too_strong boolean").join(F.broadcast(counts), "name")


@query("field_check", "P10", """
SELECT * FROM (VALUES ('o_comment', 'missing_in_dictionary'), ('o_clerk', 'missing_in_blacklist'), ('o_orderdate', 'prefix:o_order'), ('o_orderkey', 'prefix:o_order'),
  ('o_orderpriority', 'prefix:o_order'), ('o_orderstatus', 'prefix:o_order')) AS t(field, finding), (SELECT count(*) AS n_rows FROM orders)""")
def field_check(spark, sf):
    df = table(spark, sf, "orders")
    rows = pol.field_check(df.columns, POLICY)
    n = df.agg(F.count("*").alias("n_rows"))
    return spark.createDataFrame(rows, "field string, finding string").join(F.broadcast(n))


@query("normalized_types", "P11", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS DOUBLE) AS large FROM orders")
def normalized_types(spark, sf):
    df = table(spark, sf, "orders").withColumn("large", F.col("o_totalprice") > 250000)
    return lab.normalize_numeric(df, ["o_custkey", "large"]).select("o_orderkey", "o_custkey", "large")


@query("feature_projection", "P13", "SELECT l_returnflag, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL")
def feature_projection(spark, sf):
    df = table(spark, sf, "lineitem")
    keep = pol.column_policy(df.columns, POLICY_LINES).keep
    chosen = pol.prune(pol.project(df, keep, ["l_returnflag"]), ["l_extendedprice"])
    return chosen.groupBy(*chosen.columns).agg(F.count("*").alias("n"))


@query("code_inputs", "P14", f"WITH {b.CTE_MAIN} SELECT _row_id, _obs_time, n_lines, total FROM main")
def code_inputs(spark, sf):
    return pol.code_inputs(b.main(spark, sf), ["total", "n_lines", "qty_sum", "status"], unavailable=["status"], quarantined=["qty_sum"]).select(ID, OBS, "n_lines", "total")


@query("label_from_column", "P2", "SELECT quality AS _label, count(*) AS n FROM labels GROUP BY 1")
def label_from_column(spark, sf):
    df = lab.with_label(table(spark, sf, "labels"), LabelRule("quality"))
    return df.groupBy(LABEL).agg(F.count("*").alias("n"))
