"""Point-in-time feature factory and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.columns import ID, OBS
from siftmill.operators import factory, registry
from siftmill.operators.factory import Template
from siftmill.operators.label import SentinelRule
from siftmill.operators.screen import single_feature_auc
from siftmill.queries.base import query, r, rounded, table
from siftmill.session import scratch_root

OBS_DAY = "1999-01-01"
# Detail table: orders seen from one observation day, in relative days (negative = past).
DETAIL_SQL = f"""detail AS (
  SELECT o_custkey AS cust, date_diff('day', DATE '{OBS_DAY}', CAST(o_orderdate AS DATE)) AS days, o_totalprice AS amount, o_orderstatus AS status,
         CASE WHEN o_orderkey % 97 = 0 THEN 365243 ELSE o_orderkey % 500 END AS code, o_orderpriority AS priority, o_orderkey AS okey FROM orders)"""
CODE = SentinelRule(365243, ("code",))


def detail(spark, sf):
    o = table(spark, sf, "orders")
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit(OBS_DAY).cast("date"))
    code = F.when(F.col("o_orderkey") % 97 == 0, 365243).otherwise(F.col("o_orderkey") % 500)
    return o.select(F.col("o_custkey").alias("cust"), days.alias("days"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), code.alias("code"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("okey"))


HISTORY = Template(
    id="hist", source="orders", entity="cust", time_field="days", time_unit="days", windows=(180, 365, "all"),
    aggs=("count", "count_distinct(priority)", "count_if(status = 'F')", "avg(status = 'F')", "max(code)   # monotone_prior: -1", "avg(amount / NULLIF(code, 0))"),
    derived=("ratio(180/365)", "trend(180 vs all)", "recency: -max(days)"), extra_filter="priority <> '5-LOW'", prior=1, rationale="recent activity",
)



def _history_sql() -> str:
    exprs = {0: "count(*)", 1: "count(DISTINCT priority)", 2: "count_if(status = 'F')", 3: "avg(CASE WHEN status = 'F' THEN CAST(1 AS DOUBLE) ELSE 0 END)", 4: "max(code)", 5: "avg(CAST(amount AS DOUBLE) / NULLIF(code, 0))"}
    cols, pairs = [], []
    for i, e in exprs.items():
        for w in (180, 365, "all"):
            body = e if w == "all" else f"{e} FILTER (WHERE days >= -{w})"
            if i == 2:
                body = "count(*) FILTER (WHERE status = 'F'" + ("" if w == "all" else f" AND days >= -{w}") + ")"
            cols.append(f"{body} AS hist__a{i}__w{w}")
        pairs.append(f"CAST(hist__a{i}__w180 AS DOUBLE) / NULLIF(hist__a{i}__w365, 0) AS hist__a{i}__ratio_180_365")
        pairs.append(f"CAST(hist__a{i}__w180 AS DOUBLE) - hist__a{i}__wall AS hist__a{i}__trend_180_all")
    return f"""agg AS (SELECT cust, {', '.join(cols)}, -max(days) AS hist__recency2
  FROM (SELECT * REPLACE (NULLIF(code, 365243) AS code) FROM detail) d WHERE days <= 0 AND priority <> '5-LOW' GROUP BY cust),
full_agg AS (SELECT cust AS _row_id, * EXCLUDE (cust), {', '.join(pairs)} FROM agg)"""


ROUNDED = ["hist__a3__w180", "hist__a3__w365", "hist__a3__wall", "hist__a5__w180", "hist__a5__w365", "hist__a5__wall"] + [f"hist__a{i}__{k}" for i in range(6) for k in ("ratio_180_365", "trend_180_all")]


def _select_history(prefix="full_agg", columns=None):
    whole = [f"hist__a{i}__w{w}" for i in (0, 1, 2, 4) for w in (180, 365, "all")] + ["hist__recency2"]
    return ", ".join([f"{prefix}.{c}" for c in whole] + [f"{r(f'{prefix}.{c}')} AS {c}" for c in ROUNDED])


@query("windowed_features", "FA2,FA3,FA4,FA5,FA6,FA7,A1", f"WITH {DETAIL_SQL}, {_history_sql()} SELECT _row_id, {_select_history()} FROM full_agg")
def windowed_features(spark, sf):
    return rounded(factory.compute_features(detail(spark, sf), HISTORY, [CODE]), 6, *ROUNDED)


@query("features_for_ids", "FA1,FA8,J1", f"""
WITH {DETAIL_SQL}, {_history_sql()}, ids AS (SELECT c_custkey AS _row_id FROM customer UNION ALL SELECT c_custkey + 10000000 FROM customer WHERE c_custkey < 20)
SELECT ids._row_id, hist__a0__w180, hist__a0__wall, hist__recency2 FROM ids LEFT JOIN full_agg ON ids._row_id = full_agg._row_id""")
def features_for_ids(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"))
    ids = c.unionByName(c.where("cust < 20").select((F.col("cust") + 10_000_000).alias("cust")))
    return factory.compute_features(detail(spark, sf), HISTORY, [CODE], ids).select(ID, "hist__a0__w180", "hist__a0__wall", "hist__recency2")


ROW_TEMPLATE = Template(id="row", source="orders", entity="o_orderkey", aggs=("try_divide(o_totalprice, o_custkey % 3)   # ratio, monotone_prior: 1", "o_totalprice / 1000"), prior=0)


@query("row_template", "FA1", f"""
SELECT o_orderkey AS _row_id, {r('o_totalprice / NULLIF(o_custkey % 3, 0)', 9)} AS row__a0, o_totalprice / 1000 AS row__a1
FROM orders WHERE o_orderstatus = 'F'""")
def row_template(spark, sf):
    o = table(spark, sf, "orders")
    out = factory.compute_features(o, ROW_TEMPLATE, ids=o.where("o_orderstatus = 'F'").select("o_orderkey"))
    return rounded(out, 9, "row__a0")


@query("months_template", "FA2,FA3", """
SELECT user_id AS _row_id, count(*) FILTER (WHERE m >= -2) AS mon__a0__w2, count(*) AS mon__a0__wall,
       CAST(sum(v) FILTER (WHERE m >= -2) AS BIGINT) AS mon__a1__w2, CAST(sum(v) AS BIGINT) AS mon__a1__wall
FROM (SELECT user_id, CAST(event_id % 4 AS INTEGER) - 3 AS m, event_id % 7 AS v FROM events) WHERE m <= -1 GROUP BY 1""")
def months_template(spark, sf):
    e = table(spark, sf, "events").select("user_id", ((F.col("event_id") % 4).cast("int") - 3).alias("m"), (F.col("event_id") % 7).alias("v"))
    return factory.compute_features(e, Template(id="mon", source="events", entity="user_id", aggs=("count", "sum(v)"), windows=(2, "all"), time_field="m", time_unit="months"))


@query("pit_filter", "FA2", f"WITH {DETAIL_SQL} SELECT count(*) AS n, min(days) AS first_day, max(days) AS last_day FROM detail WHERE days <= 0 AND priority <> '5-LOW'")
def pit_filter(spark, sf):
    return factory.point_in_time(detail(spark, sf), HISTORY).agg(F.count("*").alias("n"), F.min("days").alias("first_day"), F.max("days").alias("last_day"))


@query("two_level_features", "FA9", f"""
WITH per AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS top, avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS ret FROM lineitem GROUP BY 1)
SELECT o_custkey AS _row_id, max(n) AS lines_max, CAST(sum(n) AS BIGINT) AS lines_sum, {r('avg(ret)')} AS return_share, max(top) AS qty_max
FROM per JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def two_level_features(spark, sf):
    link = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = factory.two_level(
        table(spark, sf, "lineitem"), link, "l_orderkey", "o_custkey",
        {"n": "count(*)", "top": "max(l_quantity)", "ret": "avg(cast((l_returnflag = 'R') as double))"},
        {"lines_max": "max(n)", "lines_sum": "sum(n)", "return_share": "avg(ret)", "qty_max": "max(top)"},
    )
    return rounded(out, 6, "return_share")


@query("joined_features", "FA10", f"""
WITH a AS (SELECT o_custkey, sum(o_totalprice) AS debt, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey AS _row_id, {r('debt / NULLIF(c_acctbal, 0)', 4)} AS debt_to_balance, n AS n_open FROM customer LEFT JOIN a ON c_custkey = o_custkey""")
def joined_features(spark, sf):
    agg = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias(ID)).agg(F.sum("o_totalprice").alias("debt"), F.count("*").alias("n"))
    main = table(spark, sf, "customer").withColumn(ID, F.col("c_custkey"))
    return rounded(factory.joined_features(agg, main, {"debt_to_balance": "try_divide(debt, c_acctbal)", "n_open": "n"}), 4, "debt_to_balance")


@query("depth_template", "FA11", f"WITH {DETAIL_SQL} SELECT cust AS _row_id, -(min(days)) AS depth__a0__wall, count(*) AS depth__a1__wall, count(*) FILTER (WHERE status = 'F') AS depth__a2__wall FROM detail WHERE days <= 0 GROUP BY 1")
def depth_template(spark, sf):
    t = Template(id="depth", source="orders", entity="cust", aggs=("-min(days)   # oldest record", "count", "count_if(status = 'F')"), windows=("all",), extra_filter="days <= 0")
    return factory.compute_features(detail(spark, sf), t)


# Every number of the detail table, and products and shares of them: 32 columns, 129 features.
BASE_NUMBERS = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
MADE_NUMBERS = {f"price_{k}": f"l_extendedprice * {k} / (l_quantity + {k}.37)" for k in range(1, 14)} | {f"cost_{k}": f"l_quantity * (1 - l_discount) / {k}.37 + l_tax" for k in range(1, 13)}
DEEP = (*BASE_NUMBERS, *MADE_NUMBERS)
_DIGITS = {c: 6 if c in BASE_NUMBERS else 4 for c in DEEP}
_DEEP_SQL = ", ".join(f"{r(f'{fn}({c})', _DIGITS[c])} AS {p}_line_{c}" for c in DEEP for p, fn in (("max", "max"), ("min", "min"), ("mean", "avg"), ("sum", "sum")))


@query("deep_aggregates", "FA12", f"""
WITH made AS (SELECT l_orderkey, l_shipdate, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in BASE_NUMBERS)}, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in MADE_NUMBERS.items())} FROM lineitem)
SELECT l_orderkey AS _row_id, count(*) AS count_line, {_DEEP_SQL} FROM made WHERE l_shipdate < DATE '1998-01-01' GROUP BY 1""")
def deep_aggregates(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", *[F.col(c).cast("double").alias(c) for c in BASE_NUMBERS])
    before = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    out = factory.deep_aggregate(lines, "l_orderkey", "line", before, DEEP, made={c: f"cast({e} as double)" for c, e in MADE_NUMBERS.items()})
    out = rounded(out, 6, *[f"{p}_line_{c}" for p in factory.PRIMITIVES for c in BASE_NUMBERS])
    return rounded(out, 4, *[f"{p}_line_{c}" for p in factory.PRIMITIVES for c in MADE_NUMBERS])


@query("relative_cutoff", "FA13", f"""
SELECT strftime(DATE '{OBS_DAY}' + CAST(o_orderkey % 400 - 300 AS INTEGER), '%Y-%m-%d') AS event_day, count(*) AS n
FROM orders WHERE o_orderkey % 400 - 300 <= 0 GROUP BY 1""")
def relative_cutoff(spark, sf):
    from siftmill.functions.dates import relative_day_to_date

    o = table(spark, sf, "orders").withColumn("rel", (F.col("o_orderkey") % 400 - 300).cast("int"))
    o = o.withColumn("day", relative_day_to_date(OBS_DAY, "rel")).where(F.col("day") <= F.lit(OBS_DAY).cast("date"))
    return o.groupBy(F.date_format("day", "yyyy-MM-dd").alias("event_day")).agg(F.count("*").alias("n"))


@query("feature_store", "FA14,J1", f"""
WITH {DETAIL_SQL}, {_history_sql()}
SELECT c_custkey AS _row_id, hist__a0__w365, hist__a2__wall FROM customer LEFT JOIN full_agg ON c_custkey = _row_id""")
def feature_store(spark, sf):
    store = registry.FeatureStore(spark, f"{scratch_root(spark)}/{factory.feature_set_id('demo', HISTORY.id, sf)}")
    fs_id = factory.feature_set_id("orders", HISTORY.id, "v1")
    store.register(fs_id, factory.compute_features(detail(spark, sf), HISTORY, [CODE]), factory.feature_definitions(HISTORY), ["hist__a0__w365", "hist__a2__wall"])
    return store.attach(table(spark, sf, "customer").select(F.col("c_custkey").alias(ID)), [fs_id])


_DEFINED = [(d["name"], d["window"], d["prior"]) for d in factory.feature_definitions(HISTORY)]


@query("feature_definitions", "FA15", f"""
WITH {DETAIL_SQL}, {_history_sql()} """ + " UNION ALL ".join(f"SELECT '{n}' AS name, '{w}' AS \"window\", CAST({'NULL' if p is None else p} AS INTEGER) AS prior, count({n}) AS n_filled FROM full_agg" for n, w, p in _DEFINED))
def feature_definitions(spark, sf):
    """Every definition of the template with the entities that have a value."""
    feats = factory.compute_features(detail(spark, sf), HISTORY, [CODE])
    names = [n for n, *_ in _DEFINED]
    counts = feats.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "name", "n_filled")
    return spark.createDataFrame(_DEFINED, "name string, window string, prior int").join(F.broadcast(counts), "name")


@query("observed_windows", "FA2,FA3", f"""
WITH rows_ AS (SELECT o_orderkey, o_custkey, o_orderdate AS t, o_totalprice FROM orders),
j AS (SELECT a.o_orderkey, b.o_totalprice, date_diff('microsecond', b.t, a.t) / 86400000000.0 AS age FROM rows_ a JOIN rows_ b ON a.o_custkey = b.o_custkey AND b.t <= a.t)
SELECT r.o_orderkey AS _row_id, CASE WHEN count(age) > 0 THEN count(*) FILTER (WHERE age <= 90) END AS count__w90, CASE WHEN count(age) > 0 THEN count(age) END AS count__wall,
       {r('sum(j.o_totalprice) FILTER (WHERE age <= 90)', 2)} AS sum_amount__w90, {r('avg(j.o_totalprice)', 6)} AS avg_amount__wall,
       min(j.o_totalprice) FILTER (WHERE age <= 90) AS min_amount__w90, max(j.o_totalprice) AS max_amount__wall
FROM rows_ r LEFT JOIN j ON r.o_orderkey = j.o_orderkey GROUP BY 1""")
def observed_windows(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias(ID), "o_custkey", F.col("o_orderdate").alias(OBS))
    out = factory.observed_window_totals(rows, o, "o_custkey", OBS, "o_orderdate", {"amount": "o_totalprice"}, [90, "all"])
    out = out.select(ID, "count__w90", "count__wall", "sum_amount__w90", "avg_amount__wall", "min_amount__w90", "max_amount__wall")
    return rounded(rounded(out, 2, "sum_amount__w90"), 6, "avg_amount__wall")


_EVENT_WINDOWS = (0.25, 7, 90)


def _tag(w):
    return str(w).replace(".", "_")



@query("observed_instants", "FA2,FA3", f"""
WITH j AS (SELECT a.event_id, b.value, date_diff('microsecond', b.ts, a.ts) / 86400000000.0 AS age FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts WHERE a.event_type = 'purchase')
SELECT event_id AS _row_id, {', '.join(f"""count(*) FILTER (WHERE age <= {w}) AS count__w{_tag(w)}, {r(f'sum(value) FILTER (WHERE age <= {w})', 4)} AS sum_v__w{_tag(w)}, {r(f'avg(value) FILTER (WHERE age <= {w})', 10)} AS avg_v__w{_tag(w)},
  min(value) FILTER (WHERE age <= {w}) AS min_v__w{_tag(w)}, max(value) FILTER (WHERE age <= {w}) AS max_v__w{_tag(w)}""" for w in _EVENT_WINDOWS)}
FROM j GROUP BY 1""")
def observed_instants(spark, sf):
    """What each purchase knew at its instant, with its own event and events of the same instant."""
    e = table(spark, sf, "events")
    rows = e.where("event_type = 'purchase'").select(F.col("event_id").alias(ID), "user_id", F.col("ts").alias(OBS))
    out = factory.observed_window_totals(rows, e, "user_id", OBS, "ts", {"v": "value"}, _EVENT_WINDOWS, buckets=4).drop("user_id", OBS)
    out = rounded(out, 4, *[f"sum_v__w{_tag(w)}" for w in _EVENT_WINDOWS])
    return rounded(out, 10, *[f"avg_v__w{_tag(w)}" for w in _EVENT_WINDOWS])


# ---- flagship -------------------------------------------------------------------------------

FLAG_FEATURES = ["hist__a0__w180", "hist__a0__w365", "hist__a0__wall", "hist__a2__w365", "hist__a3__wall", "hist__a4__wall", "hist__recency2"]


def flagship(spark, sf):
    """Label every customer by what happens in the year after the observation day, aggregate the
    customer's earlier orders over look-back windows, and rank the features by AUC."""
    d = detail(spark, sf)
    future = d.where("days > 0 and days <= 365").groupBy(F.col("cust").alias(ID)).agg((F.count_if(F.col("status") == "F") > 0).cast("int").alias("_label"))
    feats = factory.compute_features(d, HISTORY, [CODE])
    return rounded(single_feature_auc(factory.attach(future, feats, FLAG_FEATURES), FLAG_FEATURES), 6, "auc")


@query("screened_history", "FA3,SC3,P2,J1", f"""
WITH {DETAIL_SQL}, {_history_sql()},
future AS (SELECT cust, CASE WHEN count(*) FILTER (WHERE status = 'F') > 0 THEN 1 ELSE 0 END AS y FROM detail WHERE days > 0 AND days <= 365 GROUP BY 1),
long AS (SELECT future.y, f.feature, CAST(CASE f.feature {' '.join(f"WHEN '{c}' THEN {c}" for c in FLAG_FEATURES)} END AS DOUBLE) AS v
  FROM future LEFT JOIN full_agg ON cust = _row_id, (VALUES {', '.join(f"('{c}')" for c in FLAG_FEATURES)}) AS f(feature)),
rk AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v NULLS FIRST) + (count(*) OVER (PARTITION BY feature, v) - 1) / CAST(2 AS DOUBLE) AS rnk FROM long),
a AS (SELECT feature, (sum(rnk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (sum(y) * (count(*) - sum(y))) AS auc FROM rk GROUP BY 1)
SELECT feature, {r('greatest(auc, 1 - auc)')} AS auc FROM a""")
def screened_history(spark, sf):
    return flagship(spark, sf)


@query("events_top", "L1", f"WITH e AS (SELECT user_id, {r('avg(value)')} AS mean_value FROM events GROUP BY 1) SELECT * FROM e ORDER BY mean_value DESC, user_id LIMIT 10")
def events_top(spark, sf):
    e = rounded(table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("mean_value")), 6, "mean_value")
    return e.orderBy(F.col("mean_value").desc(), "user_id").limit(10)


@query("monthly_means", "A4", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, {r('avg(o_totalprice)', 6)} AS mean_price FROM orders GROUP BY 1")
def monthly_means(spark, sf):
    from siftmill.functions.dates import month_of

    return rounded(table(spark, sf, "orders").groupBy(month_of("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price")), 6, "mean_price")


