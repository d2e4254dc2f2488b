"""Feature screening and investigation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.columns import ID
from siftmill.operators import investigate as inv
from siftmill.operators import screen as sc
from siftmill.operators.policy import FieldPolicy
from siftmill.queries import bindings as b
from siftmill.queries.base import query, r, rounded, table
from siftmill.queries.sqltext import edges_cte, long_cte, psi_cte, right_bin

NUM = b.NUMERIC
TRAIN = f"WITH {b.CTE_SPLITS}, train AS (SELECT *, _label AS y FROM splits WHERE split = 'train')"
LONG = f"{TRAIN}, {long_cte('train', NUM, extra='y')}"
BINS = f"""{edges_cte('long', 'feature', 10)},
binned AS (SELECT long.feature, y, CASE WHEN v IS NULL THEN -1 WHEN len(edges) < 3 THEN 0 ELSE {right_bin('edges', 'v')} END AS bin FROM long LEFT JOIN edges ON long.feature = edges.feature),
cells AS (SELECT feature, bin, count(*) AS n, sum(y) AS n_pos FROM binned GROUP BY 1, 2)"""
IV = """w AS (SELECT feature, bin, (n_pos + CAST(0.5 AS DOUBLE)) / sum(n_pos + CAST(0.5 AS DOUBLE)) OVER (PARTITION BY feature) AS pb,
  (n - n_pos + CAST(0.5 AS DOUBLE)) / sum(n - n_pos + CAST(0.5 AS DOUBLE)) OVER (PARTITION BY feature) AS pg FROM cells),
iv_ AS (SELECT feature, sum((pb - pg) * ln(pb / pg)) AS iv FROM w GROUP BY 1)"""
AUCS = """rk AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v NULLS FIRST) + (count(*) OVER (PARTITION BY feature, v) - 1) / CAST(2 AS DOUBLE) AS rnk FROM long),
auc0 AS (SELECT feature, (sum(rnk) FILTER (WHERE y = 1) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS a FROM rk GROUP BY 1),
auc_ AS (SELECT feature, greatest(a, 1 - a) AS auc FROM auc0)"""


def train(spark, sf):
    return b.splits(spark, sf).where("split = 'train'")


@query("missing_rates", "SC1", f"{LONG} SELECT feature, {r('avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END)')} AS missing_rate FROM long GROUP BY 1")
def missing_rates(spark, sf):
    return rounded(sc.missing_rate(train(spark, sf), NUM), 6, "missing_rate")


@query("information_value", "SC2,A3", f"{LONG}, {BINS}, {IV}, f AS (SELECT feature, count(v) AS filled FROM long GROUP BY 1) SELECT feature, CASE WHEN filled < 50 THEN 0.0::DOUBLE ELSE {r('iv')} END AS iv FROM iv_ JOIN f USING (feature)")
def information_value(spark, sf):
    return rounded(sc.information_value(train(spark, sf), NUM, buckets=8), 6, "iv")


@query("information_value_text", "SC2", f"""{TRAIN}, cells AS (SELECT f.feature, coalesce(CASE f.feature WHEN 'cat' THEN cat WHEN 'priority' THEN priority ELSE status END, '__na__') AS bin, count(*) AS n, sum(y) AS n_pos
  FROM train, (VALUES ('cat'), ('priority')) AS f(feature) GROUP BY 1, 2), {IV} SELECT feature, {r('iv')} AS iv FROM iv_""")
def information_value_text(spark, sf):
    return rounded(sc.information_value_categorical(train(spark, sf), ["cat", "priority"]), 6, "iv")


@query("single_feature_auc", "SC3", f"{LONG}, {AUCS} SELECT feature, {r('auc')} AS auc FROM auc_")
def single_feature_auc(spark, sf):
    return rounded(sc.single_feature_auc(train(spark, sf), NUM, buckets=8), 6, "auc")


@query("single_feature_auc_text", "SC3", f"""{TRAIN}, long AS (SELECT f.feature, y, CASE f.feature WHEN 'cat' THEN cat ELSE priority END AS v FROM train, (VALUES ('cat'), ('priority')) AS f(feature)),
{AUCS} SELECT feature, {r('auc')} AS auc FROM auc_""")
def single_feature_auc_text(spark, sf):
    return rounded(sc.single_feature_auc(train(spark, sf), ["cat", "priority"], text=True, buckets=4), 6, "auc")


@query("leak_alarm", "SC4", f"{LONG}, {AUCS} SELECT feature, {r('auc')} AS auc FROM auc_ WHERE auc > 0.75")
def leak_alarm(spark, sf):
    return rounded(sc.leak_alarm(sc.single_feature_auc(train(spark, sf), NUM)), 6, "auc")


CORR = ["total", "n_lines", "qty_sum", "price_max", "disc_min", "signal", "signal_dup"]
PAIRS = [(a, c) for i, a in enumerate(CORR) for c in CORR[i + 1:]]
FILLED = f"""med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in CORR)} FROM train),
filled AS (SELECT {', '.join(f'coalesce(train.{c}, med.{c}) AS {c}' for c in CORR)} FROM train, med)"""


@query("correlations", "SC5", f"{TRAIN}, {FILLED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, {r(f'corr({a}, {c})')} AS corr FROM filled" for a, c in PAIRS))
def correlations(spark, sf):
    df = train(spark, sf)
    return rounded(sc.correlation_table(df, CORR, sc.medians(df, CORR)), 6, "corr")


@query("feature_psi", "SC6,A3", f"""WITH {b.CTE_SPLITS}, sides AS (SELECT *, split = 'train' AS ref FROM splits WHERE split IN ('train', 'oot_dev')), {long_cte('sides', NUM, extra='ref')},
{psi_cte('long', 'feature', 'feature', 10)} SELECT feature, {r('psi')} AS psi FROM psi_""")
def feature_psi(spark, sf):
    s = b.splits(spark, sf)
    return rounded(sc.feature_psi(s.where("split = 'train'"), s.where("split = 'oot_dev'"), NUM, buckets=8), 6, "psi")


FUNNEL = ["total", "signal", "signal_dup", "leaky", "drift_only", "sparse", "half"]


@query("screening_funnel", "SC7,SC1,SC2,SC3,SC4,SC5,SC6", f"""
WITH {b.CTE_SPLITS}, s2 AS (SELECT *, _label AS y, CAST((h * 7 + h2) % 100 + 30 * _label + CASE WHEN split = 'oot_dev' THEN 80 ELSE 0 END AS DOUBLE) AS drift_only FROM splits),
train AS (SELECT * FROM s2 WHERE split = 'train'), {long_cte('train', FUNNEL, extra='y')}, {BINS}, {IV}, {AUCS},
miss AS (SELECT feature, avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS missing FROM long GROUP BY 1),
sides AS (SELECT *, split = 'train' AS ref FROM s2 WHERE split IN ('train', 'oot_dev')), {long_cte('sides', FUNNEL, 'long2', 'ref')}, {psi_cte('long2', 'feature', 'feature', 10)},
stage1 AS (SELECT feature, missing, iv, auc, psi, CASE WHEN missing > 0.95 THEN 'missing' WHEN iv < 0.02 THEN 'low_iv' WHEN auc > 0.75 THEN 'leak_suspect' END AS out1
  FROM miss JOIN iv_ USING (feature) JOIN auc_ USING (feature) JOIN psi_ USING (feature)),
stage2 AS (SELECT *, row_number() OVER (PARTITION BY out1 IS NULL ORDER BY round(iv, 10) DESC, feature) AS pos FROM stage1),
twins AS (SELECT 'signal' AS a, 'signal_dup' AS b WHERE (SELECT abs(corr(signal, signal_dup)) FROM train) > 0.9),
stage3 AS (SELECT s.*, EXISTS (SELECT 1 FROM twins t JOIN stage2 o ON o.feature IN (t.a, t.b) AND o.feature <> s.feature WHERE s.feature IN (t.a, t.b) AND o.out1 IS NULL AND o.pos < s.pos) AS near FROM stage2 s)
SELECT feature, {r('missing')} AS missing, CASE WHEN missing > 0.95 THEN NULL ELSE {r('iv')} END AS iv,
       CASE WHEN missing > 0.95 OR iv < 0.02 THEN NULL ELSE {r('auc')} END AS auc, CASE WHEN out1 IS NOT NULL OR near THEN NULL ELSE {r('psi')} END AS psi,
       CASE WHEN out1 IS NOT NULL THEN out1 WHEN near THEN 'corr' WHEN psi > 0.25 THEN 'psi' ELSE 'kept' END AS outcome FROM stage3""")
def screening_funnel(spark, sf):
    late = F.when(F.col("split") == "oot_dev", 80).otherwise(0)
    s = b.splits(spark, sf).withColumn("drift_only", ((F.col("h") * 7 + F.col("h2")) % 100 + 30 * F.col("_label") + late).cast("double"))
    res = sc.screen(s.where("split = 'train'"), s.where("split = 'oot_dev'"), FUNNEL)
    return rounded(res.table, 6, "missing", "iv", "auc", "psi")


@query("mutual_information", "IV1", f"""{LONG}, {BINS}, t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS nn, CAST(sum(n_pos) OVER (PARTITION BY feature) AS DOUBLE) AS pp FROM cells),
j AS (SELECT feature, nn, n AS m, n_pos AS c, pp AS s FROM t UNION ALL SELECT feature, nn, n, n - n_pos, nn - pp FROM t)
SELECT feature, {r('sum(CASE WHEN c > 0 THEN c / nn * ln((c / nn) / ((m / nn) * (s / nn))) ELSE 0 END)')} AS mi FROM j GROUP BY 1""")
def mutual_information(spark, sf):
    return rounded(inv.mutual_information(train(spark, sf), NUM), 6, "mi")


@query("target_rate_by_bin", "IV2", f"""{LONG}, {BINS} SELECT feature, CAST(CASE WHEN bin < 0 THEN bin ELSE dense_rank() OVER (PARTITION BY feature, bin < 0 ORDER BY bin) - 1 END AS INTEGER) AS bin, n, {r('CAST(n_pos AS DOUBLE) / n')} AS target_rate,
  {r('(CAST(n_pos AS DOUBLE) / n) / (CAST(sum(n_pos) OVER (PARTITION BY feature) AS DOUBLE) / sum(n) OVER (PARTITION BY feature))')} AS lift FROM cells""")
def target_rate_by_bin(spark, sf):
    return rounded(inv.target_rate_by_bin(train(spark, sf), NUM), 6, "target_rate", "lift")


@query("target_rate_by_category", "IV2,L4", f"""
WITH t AS (SELECT CAST(o_custkey % 37 AS VARCHAR) AS grp, {b.LABEL_SQL} AS y FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT grp, row_number() OVER (ORDER BY count(*) DESC, grp) AS rk FROM t GROUP BY 1),
cells AS (SELECT CASE WHEN rk <= 10 THEN '=' || t.grp ELSE 'other' END AS bin, count(*) AS n, sum(y) AS n_pos FROM t JOIN c ON t.grp = c.grp GROUP BY 1)
SELECT 'grp' AS feature, bin, n, {r('CAST(n_pos AS DOUBLE) / n')} AS target_rate, {r('(CAST(n_pos AS DOUBLE) / n) / (SELECT avg(CAST(y AS DOUBLE)) FROM t)')} AS lift FROM cells""")
def target_rate_by_category(spark, sf):
    df = b.main(spark, sf).withColumn("grp", (F.col("cust") % 37).cast("string")).where("_label is not null")
    return rounded(inv.target_rate_by_category(df, ["grp"]), 6, "target_rate", "lift")


STABLE = ["total", "qty_sum", "signal", "drift", "half", "sparse"]


@query("stability_psi", "IV3", f"""{TRAIN}, o AS (SELECT epoch(_obs_time) AS t, row_number() OVER (ORDER BY _obs_time) - 1 AS rn, count(*) OVER () - 1 AS top FROM train),
med AS (SELECT (max(t) FILTER (WHERE rn = floor(top * 0.5)) + max(t) FILTER (WHERE rn = ceil(top * 0.5))) / 2 AS half_time FROM o),
halves AS (SELECT train.*, epoch(_obs_time) <= half_time AS ref FROM train, med), {long_cte('halves', STABLE, extra='ref')}, {psi_cte('long', 'feature', 'feature', 10)},
big AS (SELECT feature FROM long WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE ref) > 50 AND count(*) FILTER (WHERE NOT ref) > 50)
SELECT feature, {r('psi')} AS psi FROM psi_ SEMI JOIN big USING (feature)""")
def stability_psi(spark, sf):
    return rounded(inv.stability_psi(train(spark, sf), STABLE), 6, "psi")


@query("missing_vs_target", "IV4", f"""{LONG}, m AS (SELECT feature, avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS missing_rate, avg(CAST(y AS DOUBLE)) FILTER (WHERE v IS NULL) AS a, avg(CAST(y AS DOUBLE)) FILTER (WHERE v IS NOT NULL) AS c FROM long GROUP BY 1)
SELECT feature, {r('missing_rate')} AS missing_rate, {r('a')} AS target_rate_missing, {r('c')} AS target_rate_present, {r('abs(a - c)')} AS gap FROM m WHERE missing_rate > 0.01 AND missing_rate < 0.99""")
def missing_vs_target(spark, sf):
    return rounded(inv.missing_vs_target(train(spark, sf), NUM), 6, "missing_rate", "target_rate_missing", "target_rate_present", "gap")


RANKED = ["total", "signal", "signal_dup", "qty_sum"]
RANK_SQL = "ranks AS (SELECT " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) END AS {c}" for c in RANKED) + " FROM train)"
RANK_PAIRS = [(a, c) for i, a in enumerate(RANKED) for c in RANKED[i + 1:]]


@query("redundant_pairs", "IV5", f"{TRAIN}, {RANK_SQL}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, {r(f'abs(corr({a}, {c}))')} AS corr FROM ranks" for a, c in RANK_PAIRS) + ") SELECT * FROM p WHERE corr > 0.9")
def redundant_pairs(spark, sf):
    return rounded(inv.redundant_pairs(train(spark, sf), RANKED, buckets=4), 6, "corr")


# Text features count by how often their value occurs.
TEXT = ["cat_text", "status", "priority"]
TRAIN_TEXT = f"""WITH {b.CTE_SPLITS}, train AS (SELECT _row_id, _label AS y, _obs_time, signal, CASE WHEN cat IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY cat) AS DOUBLE) END AS cat_text,
  CAST(count(*) OVER (PARTITION BY status) AS DOUBLE) AS status, CAST(count(*) OVER (PARTITION BY priority) AS DOUBLE) AS priority FROM splits WHERE split = 'train')"""


def text_train(spark, sf):
    return train(spark, sf).select(ID, "_label", "_obs_time", "signal", F.col("cat").alias("cat_text"), "status", "priority")


@query("mutual_information_text", "IV1", f"""{TRAIN_TEXT}, {long_cte('train', TEXT, extra='y')}, {BINS}, t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS nn, CAST(sum(n_pos) OVER (PARTITION BY feature) AS DOUBLE) AS pp FROM cells),
j AS (SELECT feature, nn, n AS m, n_pos AS c, pp AS s FROM t UNION ALL SELECT feature, nn, n, n - n_pos, nn - pp FROM t)
SELECT feature, {r('sum(CASE WHEN c > 0 THEN c / nn * ln((c / nn) / ((m / nn) * (s / nn))) ELSE 0 END)')} AS mi FROM j GROUP BY 1""")
def mutual_information_text(spark, sf):
    return rounded(inv.mutual_information(text_train(spark, sf), TEXT), 6, "mi")


@query("stability_psi_text", "IV3", f"""{TRAIN_TEXT}, o AS (SELECT epoch(_obs_time) AS t, row_number() OVER (ORDER BY _obs_time) - 1 AS rn, count(*) OVER () - 1 AS top FROM train),
med AS (SELECT (max(t) FILTER (WHERE rn = floor(top * 0.5)) + max(t) FILTER (WHERE rn = ceil(top * 0.5))) / 2 AS half_time FROM o),
halves AS (SELECT train.*, epoch(_obs_time) <= half_time AS ref FROM train, med), {long_cte('halves', TEXT, extra='ref')}, {psi_cte('long', 'feature', 'feature', 10)},
big AS (SELECT feature FROM long WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE ref) > 50 AND count(*) FILTER (WHERE NOT ref) > 50)
SELECT feature, {r('psi')} AS psi FROM psi_ SEMI JOIN big USING (feature)""")
def stability_psi_text(spark, sf):
    return rounded(inv.stability_psi(text_train(spark, sf), TEXT), 6, "psi")


TEXT_PAIRS = [(a, c) for i, a in enumerate([*TEXT, "signal"]) for c in [*TEXT, "signal"][i + 1:]]


@query("redundant_pairs_text", "IV5", f"{TRAIN_TEXT}, ranks AS (SELECT " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) END AS {c}" for c in [*TEXT, "signal"])
    + " FROM train), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, {r(f'abs(corr({a}, {c}))')} AS corr FROM ranks WHERE {a} IS NOT NULL AND {c} IS NOT NULL" for a, c in TEXT_PAIRS) + ") SELECT * FROM p WHERE corr > 0.01")
def redundant_pairs_text(spark, sf):
    return rounded(inv.redundant_pairs(text_train(spark, sf), [*TEXT, "signal"], limit=0.01, buckets=4), 6, "corr")


@query("frequency_encoding", "IV6", "SELECT o_orderkey AS _row_id, count(*) OVER (PARTITION BY o_orderpriority) AS o_orderpriority__freq, count(*) OVER (PARTITION BY o_custkey) AS cust__freq FROM orders")
def frequency_encoding(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ID), "o_orderpriority", F.col("o_custkey").alias("cust"))
    return inv.frequency_encode(df, ["o_orderpriority", "cust"])


@query("top_features", "L1,SC3", f"{LONG}, {AUCS}, z AS (SELECT feature, {r('auc')} AS auc FROM auc_) SELECT * FROM z ORDER BY auc DESC, feature LIMIT 5")
def top_features(spark, sf):
    return inv.top_features(rounded(sc.single_feature_auc(train(spark, sf), NUM), 6, "auc"), "auc", 5)


SCAN = FieldPolicy(fields={"total": {"availability": "application"}, "qty_sum": {"availability": "post_outcome"}, "leaky": {"availability": "application"}, "signal": {"availability": "application"}, "cat": {"availability": "application"}}, patterns=("^price_",))
SCANNED = ["total", "qty_sum", "leaky", "signal", "price_max", "half"]


@query("leak_scan", "C1,Q10", f"""{LONG}, {AUCS}, meta(feature, unavailable, name_hit, is_history) AS (VALUES ('total', FALSE, FALSE, FALSE), ('qty_sum', TRUE, FALSE, FALSE), ('leaky', FALSE, FALSE, FALSE), ('signal', FALSE, FALSE, FALSE), ('price_max', TRUE, TRUE, FALSE), ('half', FALSE, FALSE, TRUE))
SELECT feature, CASE WHEN NOT is_history THEN {r('auc')} END AS auc, unavailable, name_hit, (auc > 0.75 AND NOT is_history) OR unavailable OR name_hit AS suspect FROM auc_ JOIN meta USING (feature)""")
def leak_scan(spark, sf):
    return rounded(sc.scan_features(train(spark, sf), SCANNED, [], SCAN, history=["half"]), 6, "auc")


@query("post_outcome_fields", "Q10", f"""{LONG}, {AUCS}, meta(feature, unavailable, name_hit) AS (VALUES ('total', FALSE, FALSE), ('qty_sum', TRUE, FALSE), ('leaky', FALSE, FALSE), ('signal', FALSE, FALSE), ('price_max', TRUE, TRUE)),
s AS (SELECT feature, auc, CASE WHEN unavailable AND name_hit THEN 'availability,name_pattern' WHEN unavailable THEN 'availability' WHEN name_hit THEN 'name_pattern' WHEN auc > 0.75 THEN 'single_feature_auc' END AS reasons FROM auc_ JOIN meta USING (feature))
SELECT feature AS "column", reasons, {r('auc')} AS auc FROM s WHERE reasons IS NOT NULL""")
def post_outcome_fields(spark, sf):
    from siftmill.operators.quality import post_outcome_fields as detect

    return rounded(detect(sc.scan_features(train(spark, sf), ["total", "qty_sum", "leaky", "signal", "price_max"], [], SCAN)), 6, "auc")


