"""Profiling, detectors, planted issues and their scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL
from siftmill.operators import inject
from siftmill.operators import quality as ql
from siftmill.operators.label import LabelRule
from siftmill.plans.sampling import choose
from siftmill.queries import bindings as b
from siftmill.queries.base import hash_mod, query, r, rounded, sql_hash_mod, table, union_all
from siftmill.queries.sqltext import long_cte
from siftmill.sources import subset

PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}
_SPANS = ["o_orderkey", "o_custkey", "o_totalprice"]
_ENDS = lambda fn: "CASE v.c " + " ".join(f"WHEN '{c}' THEN (SELECT CAST({fn}({c}) AS DOUBLE) FROM orders)" for c in _SPANS) + " END"


@query("table_profile", "Q1", """WITH v AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM orders" for c in PROFILED) + f"""),
d AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS rk FROM (SELECT DISTINCT c, v FROM v WHERE v IS NOT NULL)),
e AS (SELECT c, string_agg(v, '|' ORDER BY rk) AS examples FROM d WHERE rk <= 5 GROUP BY 1)
SELECT v.c AS "column", CASE v.c {' '.join(f"WHEN '{c}' THEN '{t}'" for c, t in PROFILED.items())} END AS sql_type, count(*) AS n_rows, {r('avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END)')} AS missing_rate,
       count(DISTINCT v) AS n_unique, max(examples) AS examples, {_ENDS('min')} AS min_value, {_ENDS('max')} AS max_value FROM v JOIN e ON v.c = e.c GROUP BY v.c""")
def table_profile(spark, sf):
    df = table(spark, sf, "orders").select(*PROFILED)
    return rounded(ql.profile(df), 6, "missing_rate")


@query("date_candidates", "Q2", """
WITH t AS (SELECT 'month_text' AS "column", strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders UNION ALL SELECT 'free', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders),
s AS (SELECT "column", avg(CASE WHEN TRY_CAST(v AS DATE) IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS parse_share FROM t WHERE v IS NOT NULL GROUP BY 1)
SELECT "column", "column" = 'month_text' AS by_name, parse_share, "column" = 'month_text' OR parse_share > 0.9 AS candidate FROM s""")
def date_candidates(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return ql.date_candidates(table(spark, sf, "orders").select(day.alias("month_text"), day.alias("free"), "o_orderstatus"))


@query("label_candidates", "Q3", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0) AS n_zero, count(*) FILTER (WHERE {c} = 1) AS n_one, count({c}) AS n_filled FROM labels" for c in ("quality", "toxic")))
def label_candidates(spark, sf):
    return ql.label_candidates(table(spark, sf, "labels"))


STAT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STAT_LONG = f"WITH {long_cte('lineitem', STAT)}"


@query("top_values", "Q4", """WITH t AS (SELECT 'l_returnflag' AS c, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem),
k AS (SELECT c, v, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS rank FROM t GROUP BY 1, 2) SELECT c AS "column", CAST(rank AS INTEGER) AS rank, v AS value, n FROM k WHERE rank <= 5""")
def top_values(spark, sf):
    return ql.top_values(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], 5)


@query("column_statistics", "Q4,A3", f"""{STAT_LONG} SELECT feature AS "column", count(*) AS n, {r('avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END)')} AS missing_rate, count(DISTINCT v) AS n_unique, min(v) AS min_value, max(v) AS max_value,
  {r('quantile_cont(v, 0.01)')} AS p1, {r('quantile_cont(v, 0.5)')} AS p50, {r('quantile_cont(v, 0.99)')} AS p99, count(*) FILTER (WHERE v = lo) AS n_at_min, count(*) FILTER (WHERE v = hi) AS n_at_max
FROM (SELECT *, min(v) OVER (PARTITION BY feature) AS lo, max(v) OVER (PARTITION BY feature) AS hi FROM long) GROUP BY 1""")
def column_statistics(spark, sf):
    return rounded(ql.column_stats(table(spark, sf, "lineitem"), STAT, buckets=8), 6, "missing_rate", "p1", "p50", "p99")


DIRTY_SQL = f"""dirty AS (SELECT *, {sql_hash_mod('s', 'o_orderkey', 100)} AS h FROM orders),
d AS (SELECT o_orderkey, CASE WHEN h < 3 THEN CAST(9999999 AS DOUBLE) ELSE o_totalprice END AS price, CASE WHEN h BETWEEN 10 AND 11 THEN CAST(-1 AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END AS cust,
  CASE WHEN h = 20 THEN 'XNA' WHEN h = 21 THEN 'Jan-1900' ELSE o_orderpriority END AS priority FROM dirty)"""


def dirty(spark, sf):
    o = table(spark, sf, "orders").withColumn("h", hash_mod("s", "o_orderkey", 100))
    h = F.col("h")
    return o.select(
        "o_orderkey", F.when(h < 3, 9999999.0).otherwise(F.col("o_totalprice")).alias("price"), F.when(h.between(10, 11), -1.0).otherwise(F.col("o_custkey").cast("double")).alias("cust"),
        F.when(h == 20, "XNA").when(h == 21, "Jan-1900").otherwise(F.col("o_orderpriority")).alias("priority"),
    )


@query("sentinel_candidates", "Q5", f"""WITH {DIRTY_SQL}, {long_cte('d', ['price', 'cust'])}, c AS (SELECT feature, v, count(*) AS n FROM long GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) AS up, row_number() OVER (PARTITION BY feature ORDER BY v DESC) AS down, sum(n) OVER (PARTITION BY feature) AS total,
  lead(v) OVER (PARTITION BY feature ORDER BY v) AS nxt, lag(v) OVER (PARTITION BY feature ORDER BY v) AS prv FROM c),
q AS (SELECT feature, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM long GROUP BY 1),
e AS (SELECT feature, 'min' AS side, v, n, total, nxt - v AS gap FROM k WHERE up = 1 UNION ALL SELECT feature, 'max', v, n, total, v - prv FROM k WHERE down = 1)
SELECT feature AS "column", side, v AS value, n, {r('CAST(n AS DOUBLE) / total')} AS share, {r('gap', 4)} AS gap, v IN (-1, 99, 999, 9999, 99999, 365243) AS known
FROM e JOIN q USING (feature) WHERE CAST(n AS DOUBLE) / total >= 0.005 AND (gap >= 1.5 * iqr OR v IN (-1, 99, 999, 9999, 99999, 365243))""")
def sentinel_candidates(spark, sf):
    return rounded(rounded(ql.sentinel_candidates(dirty(spark, sf), ["price", "cust"]), 6, "share"), 4, "gap")


@query("placeholder_texts", "Q5", f"WITH {DIRTY_SQL} SELECT 'priority' AS \"column\", priority AS value, count(*) AS n FROM d WHERE priority IN ('XNA', 'Jan-1900') GROUP BY 2")
def placeholder_texts(spark, sf):
    return ql.placeholder_texts(dirty(spark, sf), ["priority"])


@query("duplicate_rows", "Q6", "WITH g AS (SELECT user_id, event_type, props, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_groups FROM g")
def duplicate_rows(spark, sf):
    return ql.duplicate_rows(table(spark, sf, "events").select("user_id", "event_type", "props"))


@query("duplicate_keys", "Q7", """WITH d AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k, l_returnflag, l_quantity FROM lineitem)
SELECT k, count(*) AS n_versions FROM d GROUP BY 1 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_returnflag", "l_quantity")
    return ql.duplicate_keys(df, "k")


VARIANTS = ("1-urgent", " 1-URGENT", "1-URGENT ")
VARIANT_SQL = f"""cand AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('5|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rk, count(*) OVER () AS n FROM orders WHERE o_orderpriority = '1-URGENT'),
varied AS (SELECT o.* REPLACE (CASE WHEN rk <= greatest(3, floor(n * CAST(0.05 AS DOUBLE))) THEN list_extract(['1-urgent', ' 1-URGENT', '1-URGENT '], CAST({sql_hash_mod('5v', 'o.o_orderkey', 3)} + 1 AS BIGINT)) ELSE o_orderpriority END AS o_orderpriority)
  FROM orders o LEFT JOIN cand ON o.o_orderkey = cand.o_orderkey)"""


def varied(spark, sf):
    return inject.plant_variants(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "1-URGENT", VARIANTS, 0.05, 5)


@query("category_variants", "Q8,X4", f"""WITH {VARIANT_SQL}, c AS (SELECT lower(trim(o_orderpriority)) AS canonical, o_orderpriority AS variant, count(*) AS n FROM varied GROUP BY 1, 2)
SELECT 'o_orderpriority' AS "column", canonical, variant, n FROM c WHERE canonical IN (SELECT canonical FROM c GROUP BY 1 HAVING count(*) > 1)""")
def category_variants(spark, sf):
    return ql.category_variants(varied(spark, sf), ["o_orderpriority", "o_orderstatus"])


GONE = ("1996-03", "1998-07")


@query("missing_months", "Q9,X5", """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders WHERE strftime(o_orderdate, '%Y-%m') NOT IN ('1996-03', '1998-07')),
e AS (SELECT UNNEST(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m) SELECT strftime(m, '%Y-%m') AS month FROM e ANTI JOIN m USING (m)""")
def missing_months(spark, sf):
    return ql.missing_months(inject.plant_missing_months(table(spark, sf, "orders"), "o_orderdate", GONE), "o_orderdate")


REL = "rel AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS ship, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def relative(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    j = table(spark, sf, "lineitem").join(o, "l_orderkey")
    day = lambda c: F.col(c).cast("date")
    return j.select(F.date_diff(day("l_shipdate"), day("o_orderdate")).alias("ship"), F.date_diff(day("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("ordered"))


@query("after_cutoff_rows", "Q11", f"WITH {REL} SELECT 'ship' AS field, count(*) AS n_rows, count(*) FILTER (WHERE ship > 0) AS n_after, {r('CAST(count(*) FILTER (WHERE ship > 0) AS DOUBLE) / count(*)')} AS share FROM rel UNION ALL SELECT 'ordered', count(*), count(*) FILTER (WHERE ordered > 0), {r('CAST(count(*) FILTER (WHERE ordered > 0) AS DOUBLE) / count(*)')} FROM rel")
def after_cutoff_rows(spark, sf):
    return rounded(ql.after_cutoff(relative(spark, sf), ["ship", "ordered"]), 6, "share")


@query("after_observation", "Q11", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_shipdate > o_orderdate) AS n_after FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def after_observation(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return ql.after_observation(table(spark, sf, "lineitem"), rows, "l_orderkey", "l_shipdate", "o_orderdate")


@query("in_record_after_cutoff", "Q12", f"WITH {REL} SELECT 'ship' AS field, count(*) AS n_rows, count(*) FILTER (WHERE ship > 0) AS n_after, {r('CAST(count(*) FILTER (WHERE ship > 0) AS DOUBLE) / count(*)')} AS share FROM rel WHERE ordered <= 0")
def in_record_after_cutoff(spark, sf):
    return rounded(ql.in_record_after_cutoff(relative(spark, sf), "ordered", ["ship"]), 6, "share")


@query("column_alerts", "Q13", f"""WITH t AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END AS gappy, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS zeroes, 1 AS one FROM orders), {long_cte('t', ['o_orderkey', 'gappy', 'zeroes', 'one'])},
s AS (SELECT feature, count(*) AS n, avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS ms, avg(CASE WHEN v = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS zs, count(DISTINCT v) AS k, count(v) AS f FROM long GROUP BY 1)
SELECT feature AS "column", {r('ms')} AS missing_share, {r('zs')} AS zero_share, k AS n_unique,
  concat_ws(',', CASE WHEN ms > 0.5 THEN 'missing' END, CASE WHEN zs > 0.5 THEN 'zeros' END, CASE WHEN k <= 1 THEN 'constant' END, CASE WHEN k = n THEN 'unique' END) AS alerts FROM s""")
def column_alerts(spark, sf):
    df = table(spark, sf, "orders").withColumns({"gappy": F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")), "zeroes": F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0), "one": F.lit(1)})
    return rounded(ql.alerts(df, ["o_orderkey", "gappy", "zeroes", "one"]), 6, "missing_share", "zero_share")


# Answers and findings per part type and brand: every third key is a known issue, every fifth is reported.
ANSWER_SQL = """answers AS (SELECT DISTINCT p_type AS "table", CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS "column", p_partkey % 7 = 0 AS optional, p_partkey % 13 = 0 AS must_find FROM part WHERE p_partkey % 3 = 0),
findings AS (SELECT p_type AS "table", CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS "column", CASE WHEN p_size % 2 = 0 THEN 'duplicate_rows' ELSE 'sentinel' END AS kind FROM part WHERE p_partkey % 5 = 0),
usable AS (SELECT DISTINCT "table", coalesce("column", '') AS c FROM findings WHERE "column" IS NOT NULL OR kind LIKE '%dup%')"""


def answers(spark, sf):
    p = table(spark, sf, "part")
    col = F.when(~(F.col("p_partkey") % 11 == 0), F.col("p_brand")).alias("column")
    a = p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("table"), col, (F.col("p_partkey") % 7 == 0).alias("optional"), (F.col("p_partkey") % 13 == 0).alias("must_find")).distinct()
    f = p.where("p_partkey % 5 = 0").select(F.col("p_type").alias("table"), col, F.when(F.col("p_size") % 2 == 0, "duplicate_rows").otherwise("sentinel").alias("kind"))
    return a, f


@query("score_findings", "Q14,J6,S3", f"""WITH {ANSWER_SQL}, m AS (SELECT a.*, u.c IS NOT NULL AS hit FROM answers a LEFT JOIN usable u ON a."table" = u."table" AND coalesce(a."column", '') = u.c),
w AS (SELECT DISTINCT f."table", coalesce(f."column", '') AS c FROM findings f WHERE NOT ((f."column" IS NOT NULL OR kind LIKE '%dup%') AND EXISTS (SELECT 1 FROM answers a WHERE a."table" = f."table" AND coalesce(a."column", '') = coalesce(f."column", ''))))
SELECT count(*) FILTER (WHERE NOT optional) AS n_answers, count(*) FILTER (WHERE NOT optional AND hit) AS n_found, {r('CAST(count(*) FILTER (WHERE NOT optional AND hit) AS DOUBLE) / count(*) FILTER (WHERE NOT optional)')} AS found_rate,
       bool_and(NOT must_find OR hit) AS must_find_ok, (SELECT count(*) FROM w) AS n_not_problems FROM m""")
def score_findings(spark, sf):
    return rounded(ql.score_findings(*answers(spark, sf)), 6, "found_rate")


@query("missed_answers", "Q14,J6", f"""WITH {ANSWER_SQL} SELECT "table", "column", must_find FROM answers a WHERE NOT optional AND NOT EXISTS (SELECT 1 FROM usable u WHERE u."table" = a."table" AND u.c = coalesce(a."column", ''))""")
def missed_answers(spark, sf):
    return ql.missed_answers(*answers(spark, sf)).select("table", "column", "must_find")


DEFS = {"finished": LabelRule("o_orderstatus", ("F",), ("O",)), "open_or_pending": LabelRule("o_orderstatus", ("O", "P"), ("F",)), "urgent": LabelRule("o_orderpriority", ("1-URGENT",), ("5-LOW",))}


@query("target_definitions", "Q15", " UNION ALL ".join(
    f"SELECT '{n}' AS definition, count(y) AS n, {r('avg(y)')} AS bad_rate, strftime(min(o_orderdate) FILTER (WHERE y IS NOT NULL), '%Y-%m') AS first_month, strftime(max(o_orderdate) FILTER (WHERE y IS NOT NULL), '%Y-%m') AS last_month FROM (SELECT *, CASE WHEN {d.column} IN ({', '.join(repr(x) for x in d.positive)}) THEN 1 WHEN {d.column} IN ({', '.join(repr(x) for x in d.negative)}) THEN 0 END AS y FROM orders)"
    for n, d in DEFS.items()))
def target_definitions(spark, sf):
    return rounded(ql.target_definitions(table(spark, sf, "orders"), DEFS, "o_orderdate"), 6, "bad_rate")


REMEDY_SQL = f"""rm AS (SELECT {b.LABEL_SQL} AS y, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"""


@query("remedy_impact", "Q16", f"""WITH {REMEDY_SQL} SELECT 'as_is' AS remedy, count(*) AS n_rows, {r('avg(y)')} AS bad_rate, {r('avg(CASE WHEN price IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END)')} AS missing_rate FROM rm
UNION ALL SELECT 'drop_rows', count(*), {r('avg(y)')}, {r('avg(CASE WHEN price IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END)')} FROM rm WHERE price IS NOT NULL
UNION ALL SELECT 'null_large', count(*), {r('avg(y)')}, {r('avg(CASE WHEN price IS NULL OR price > 400000 THEN CAST(1 AS DOUBLE) ELSE 0 END)')} FROM rm
UNION ALL SELECT 'fill_zero', count(*), {r('avg(y)')}, 0.0::DOUBLE FROM rm""")
def remedy_impact(spark, sf):
    from siftmill.operators.label import label_column

    df = table(spark, sf, "orders").select(label_column(b.STATUS).alias("y"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice")).alias("price"))
    price = F.col("price")
    out = ql.remedy_impact(df, "y", "price", {
        "drop_rows": (price.isNotNull(), price), "null_large": (F.lit(True), F.when(price <= 400000, price)), "fill_zero": (F.lit(True), F.coalesce(price, F.lit(0.0))),
    })
    return rounded(out, 6, "bad_rate", "missing_rate")


# ---- planted issues -------------------------------------------------------------------------

def _chosen_sql(name: str, src: str, seed, fraction: float, least: int = 1, where: str = "TRUE", key: str = "o_orderkey") -> str:
    return f"""{name} AS (SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key}) AS rk, count(*) OVER () AS n FROM {src} WHERE {where}) WHERE rk <= greatest({least}, floor(n * CAST({fraction} AS DOUBLE))))"""


@query("planted_sentinel", "X1,X10", f"WITH {_chosen_sql('c', 'orders', 11, 0.02)} SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM c) THEN CAST(-1 AS DOUBLE) ELSE o_totalprice END AS o_totalprice FROM orders")
def planted_sentinel(spark, sf):
    return inject.plant_sentinel(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", -1, 0.02, 11).select("o_orderkey", "o_totalprice")


@query("planted_sentinel_missing", "X1,X10", f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_totalprice END AS price FROM orders), {_chosen_sql('c', 't', 12, 0.5, where='price IS NULL')}
SELECT count(*) FILTER (WHERE o_orderkey IN (SELECT o_orderkey FROM c)) AS n_rows FROM t""")
def planted_sentinel_missing(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 > 0, F.col("o_totalprice")).alias("price"))
    return inject.recount_values(inject.plant_sentinel(df, "o_orderkey", "price", 999, 0.5, 12, only_missing=True), "price", [999.0])


@query("planted_duplicate_rows", "X2", f"WITH {_chosen_sql('c', 'orders', 13, 0.01)} SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM c)")
def planted_duplicate_rows(spark, sf):
    return inject.plant_duplicate_rows(table(spark, sf, "orders"), "o_orderkey", 0.01, 13).select("o_orderkey", "o_totalprice")


@query("planted_duplicate_keys", "X3,X10", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('14|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rk, floor(count(*) OVER () * CAST(0.005 AS DOUBLE)) AS n FROM orders),
extra AS (SELECT s.o_orderkey AS new_key, t.o_orderkey AS old_key FROM k t JOIN k s ON t.rk <= t.n AND s.rk = t.rk + t.n)
SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT new_key, o_totalprice FROM extra JOIN orders ON old_key = o_orderkey""")
def planted_duplicate_keys(spark, sf):
    return inject.plant_duplicate_keys(table(spark, sf, "orders"), "o_orderkey", 0.005, 14).select("o_orderkey", "o_totalprice")


@query("planted_variants", "X4", f"WITH {VARIANT_SQL} SELECT o_orderkey, o_orderpriority FROM varied")
def planted_variants(spark, sf):
    return varied(spark, sf).select("o_orderkey", "o_orderpriority")


@query("planted_post_outcome", "X6", f"""WITH t AS (SELECT o_orderkey, {b.LABEL_SQL} AS y FROM orders)
SELECT o_orderkey, {r(f"CASE WHEN (CAST('0x' || substr(md5('15|' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000000) < 100000 THEN 1 - y ELSE y END + ({sql_hash_mod('15j', 'o_orderkey', 2001)} - 1000) / CAST(1000 AS DOUBLE) * CAST(0.05 AS DOUBLE)")} AS after_score FROM t WHERE y IS NOT NULL""")
def planted_post_outcome(spark, sf):
    from siftmill.operators.label import drop_unlabelled, with_label

    df = drop_unlabelled(with_label(table(spark, sf, "orders"), b.STATUS))
    return rounded(inject.plant_post_outcome(df, "o_orderkey", "after_score", LABEL, 0.1, 15), 6, "after_score").select("o_orderkey", "after_score")


@query("planted_after_cutoff", "X7,Q11", f"""WITH t AS (SELECT o_orderkey, -CAST(o_custkey % 500 AS INTEGER) AS days FROM orders), {_chosen_sql('c', 't', 16, 0.01)}
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM c) THEN CAST(1 + {sql_hash_mod('16d', 'o_orderkey', 364)} AS INTEGER) ELSE days END AS days FROM t""")
def planted_after_cutoff(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (-(F.col("o_custkey") % 500)).cast("int").alias("days"))
    return inject.plant_after_cutoff(df, "o_orderkey", "days", 0.01, 16)


@query("shuffled_labels", "X8", f"""WITH {b.CTE_MAIN}, m AS (SELECT _row_id, _label FROM main WHERE _label IS NOT NULL),
a AS (SELECT _row_id, row_number() OVER (ORDER BY md5('17a|' || CAST(_row_id AS VARCHAR)), _row_id) AS rk FROM m), c AS (SELECT _label, row_number() OVER (ORDER BY md5('17b|' || CAST(_row_id AS VARCHAR)), _row_id) AS rk FROM m)
SELECT _row_id, _label FROM a JOIN c USING (rk)""")
def shuffled_labels(spark, sf):
    df = b.main(spark, sf).where("_label is not null").select(ID, LABEL)
    return inject.shuffle_label(df, ID, LABEL, 17, buckets=16)


@query("shrunk_split", "X9", f"""WITH {b.CTE_SPLITS}, o AS (SELECT _row_id, _label, row_number() OVER (PARTITION BY _label ORDER BY md5('18|' || CAST(_row_id AS VARCHAR)), _row_id) AS rk, sum(_label) OVER () AS p, sum(1 - _label) OVER () AS n FROM splits WHERE split = 'oot_dev')
SELECT _row_id, _label FROM o WHERE CASE WHEN _label = 1 THEN rk <= 45 ELSE rk <= round_even(45 * CAST(n AS DOUBLE) / p, 0) END""")
def shrunk_split(spark, sf):
    oot = b.splits(spark, sf).where("split = 'oot_dev'")
    return inject.shrink_split(oot, ID, LABEL, 45, 18).select(ID, LABEL)


@query("recounted_answers", "X10,S1", f"""WITH {VARIANT_SQL}, {_chosen_sql('c', 'orders', 13, 0.01)}
SELECT 'category_variants' AS kind, count(*) FILTER (WHERE o_orderpriority IN ('1-urgent', ' 1-URGENT', '1-URGENT ')) AS n_rows FROM varied UNION ALL SELECT 'duplicate_rows', count(*) FROM c
UNION ALL SELECT 'duplicate_key', CAST(floor(count(*) * CAST(0.005 AS DOUBLE)) AS BIGINT) FROM orders""")
def recounted_answers(spark, sf):
    o = table(spark, sf, "orders")
    kinds = {
        "category_variants": inject.recount_values(varied(spark, sf), "o_orderpriority", VARIANTS),
        "duplicate_rows": ql.duplicate_rows(inject.plant_duplicate_rows(o, "o_orderkey", 0.01, 13)).select(F.col("n_duplicates").alias("n_rows")),
        "duplicate_key": inject.recount_duplicate_key(inject.plant_duplicate_keys(o, "o_orderkey", 0.005, 14), "o_orderkey"),
    }
    return union_all([df.select(F.lit(k).alias("kind"), "n_rows") for k, df in kinds.items()])


# ---- sampling -------------------------------------------------------------------------------

@query("row_sample", "L5", "SELECT event_id FROM events ORDER BY md5('21|' || CAST(event_id AS VARCHAR)), event_id LIMIT 1234")
def row_sample(spark, sf):
    return subset.row_sample(table(spark, sf, "events"), "event_id", 1234, 21).select("event_id")


@query("fraction_sample", "L6", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('22|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rk, count(*) OVER () AS n FROM orders)
WHERE rk <= floor(n * least(1, greatest(CAST(0.1 AS DOUBLE), CAST(5000 AS DOUBLE) / n)))""")
def fraction_sample(spark, sf):
    return subset.fraction_sample(table(spark, sf, "orders"), "o_orderkey", 0.1, 5000, 22).select("o_orderkey")


@query("stratified_sample", "L7", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_orderstatus ORDER BY md5('23|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rk,
  count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_orderstatus) AS n FROM orders) WHERE rk <= round_even(n * CAST(0.1 AS DOUBLE), 0)""")
def stratified_sample(spark, sf):
    df = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return subset.stratified_sample(df, "o_orderkey", ["month", "o_orderstatus"], 0.1, 23).select("o_orderkey")


@query("top_rows_per_stratum", "L2,L5", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('24|' || CAST(event_id AS VARCHAR)), event_id) AS rk FROM events) WHERE rk <= 3""")
def top_rows_per_stratum(spark, sf):
    return choose(table(spark, sf, "events"), "event_id", 24, lambda n: F.least(n, F.lit(3)), ["user_id"]).select("user_id", "event_id")


@query("replaced_rows", "S2", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 4 <> 0 UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_custkey % 4 = 0")
def replaced_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where("o_custkey % 4 = 0").withColumn("o_totalprice", -F.col("o_totalprice"))
    return o.join(new.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(new).select("o_orderkey", "o_totalprice")
