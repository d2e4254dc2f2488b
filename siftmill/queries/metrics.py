"""Ranking metrics and comparisons over keyed predictions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from siftmill.columns import OBS
from siftmill.operators import compare, investigate
from siftmill.operators import metrics as m
from siftmill.operators.screen import value_counts_by_label
from siftmill.plans.distribution import long_buckets
from siftmill.queries import bindings as b
from siftmill.queries.base import query, r, rounded
from siftmill.queries.sqltext import auc_cte, curve_cte, long_cte, psi_cte

BY = ["exp_id", "split"]
PREDS = f"WITH {b.CTE_PREDS}"


@query("auc_by_split", "M1,U2", f"{PREDS}, {auc_cte('preds', 'exp_id, split')} SELECT exp_id, split, n_pos, n_neg, {r('auc')} AS auc FROM auc_")
def auc_by_split(spark, sf):
    return rounded(m.METRICS["auc"][0](b.preds(spark, sf), BY), 6, "auc")


@query("auc_by_split_cut", "M1", f"{PREDS}, {auc_cte('preds', 'exp_id, split')} SELECT exp_id, split, n_pos, n_neg, {r('auc')} AS auc FROM auc_")
def auc_by_split_cut(spark, sf):
    """The same with the scores cut into buckets, as for very large groups."""
    return rounded(m.auc(b.preds(spark, sf), BY, buckets=16), 6, "auc")


@query("average_precision", "M2", f"{PREDS}, {curve_cte('preds', 'exp_id, split')} SELECT exp_id, split, CAST(max(pp) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, {r('sum(pos / pp * tpos / (tpos + tneg))')} AS pr_auc FROM curve GROUP BY 1, 2")
def average_precision(spark, sf):
    return rounded(m.average_precision(b.preds(spark, sf), BY, buckets=4), 6, "pr_auc")


@query("ks_statistic", "M3", f"{PREDS}, {curve_cte('preds', 'exp_id, split')} SELECT exp_id, split, CAST(max(pp) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, {r('max(abs(cpos / pp - cneg / nn))')} AS ks FROM curve GROUP BY 1, 2")
def ks_statistic(spark, sf):
    return rounded(m.ks(b.preds(spark, sf), BY, buckets=4), 6, "ks")


@query("brier_score", "M4", f"{PREDS} SELECT exp_id, split, {r('avg(pow(p - y, 2))')} AS brier, count(*) AS n FROM preds GROUP BY 1, 2")
def brier_score(spark, sf):
    return rounded(m.brier(b.preds(spark, sf), BY), 6, "brier")


@query("top_decile", "M5,L3", f"""{PREDS}, k AS (
  SELECT *, row_number() OVER (PARTITION BY exp_id, split ORDER BY p DESC, _row_id) AS rk, count(*) OVER (PARTITION BY exp_id, split) AS n, sum(y) OVER (PARTITION BY exp_id, split) AS pp FROM preds),
t AS (SELECT *, greatest(1, CAST(CASE WHEN (n * 0.1) % 1 = 0.5 AND floor(n * 0.1) % 2 = 0 THEN floor(n * 0.1) ELSE round(n * 0.1) END AS BIGINT)) AS top FROM k)
SELECT exp_id, split, max(n) AS n, max(top) AS n_top, CAST(sum(y) FILTER (WHERE rk <= top) AS BIGINT) AS top_pos,
       {r('(CAST(sum(y) FILTER (WHERE rk <= top) AS DOUBLE) / max(top)) / (CAST(max(pp) AS DOUBLE) / max(n))')} AS lift_top10, {r('CAST(sum(y) FILTER (WHERE rk <= top) AS DOUBLE) / max(pp)')} AS recall_top10
FROM t GROUP BY 1, 2""")
def top_decile(spark, sf):
    return rounded(m.top_decile(b.preds(spark, sf), BY, buckets=8), 6, "lift_top10", "recall_top10")


@query("monthly_auc", "M6", f"""{PREDS}, monthly AS (SELECT *, strftime(_obs_time, '%Y-%m') AS month FROM preds WHERE split = 'oot_dev'), {auc_cte('monthly', 'exp_id, month')}
SELECT exp_id, month, {r('auc')} AS auc, n_pos + n_neg AS n, {r('CAST(n_pos AS DOUBLE) / (n_pos + n_neg)')} AS bad_rate FROM auc_ WHERE n_pos + n_neg >= 120 AND n_pos > 0 AND n_neg > 0""")
def monthly_auc(spark, sf):
    return rounded(m.monthly_auc(b.preds(spark, sf).where("split = 'oot_dev'"), OBS, ["exp_id"], min_n=120), 6, "auc", "bad_rate")


ROWWISE_SE = """rkd AS (SELECT *, rank() OVER (PARTITION BY exp_id, split ORDER BY p) + (count(*) OVER (PARTITION BY exp_id, split, p) - 1) / CAST(2 AS DOUBLE) AS ra,
  rank() OVER (PARTITION BY exp_id, split, y ORDER BY p) + (count(*) OVER (PARTITION BY exp_id, split, y, p) - 1) / CAST(2 AS DOUBLE) AS rc,
  sum(y) OVER (PARTITION BY exp_id, split) AS pp, sum(1 - y) OVER (PARTITION BY exp_id, split) AS nn FROM preds),
pl AS (SELECT exp_id, split, pp, nn, CASE WHEN y = 1 THEN (ra - rc) / nn END AS v10, CASE WHEN y = 0 THEN 1 - (ra - rc) / pp END AS v01 FROM rkd),
se AS (SELECT exp_id, split, CAST(max(pp) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, sqrt(var_samp(v10) / max(pp) + var_samp(v01) / max(nn)) AS auc_se FROM pl GROUP BY 1, 2)"""


@query("auc_standard_error", "M7", f"{PREDS}, {ROWWISE_SE} SELECT exp_id, split, n_pos, n_neg, {r('auc_se')} AS auc_se FROM se")
def auc_standard_error(spark, sf):
    return rounded(m.auc_standard_error(b.preds(spark, sf), BY, buckets=8), 6, "auc_se")


Z = NormalDist().inv_cdf(0.95) + NormalDist().inv_cdf(0.8)
MDE = f"(auc_se * CAST({Z!r} AS DOUBLE) * sqrt(2 * (1 - CAST(0.82 AS DOUBLE))))"


@query("oot_power", "M8,M9", f"""{PREDS}, {ROWWISE_SE}
SELECT exp_id, n_pos + n_neg AS n_oot, n_pos, {r('auc_se')} AS auc_se, {r(MDE)} AS mde, {MDE} > 0.01 AS underpowered,
       CASE WHEN {MDE} > 0.01 THEN CAST(ceil(n_pos * pow({MDE} / 0.01, 2)) AS BIGINT) END AS n_pos_needed FROM se WHERE split = 'oot_dev'""")
def oot_power(spark, sf):
    return rounded(m.oot_power(b.preds(spark, sf).where("split = 'oot_dev'"), ["exp_id"]), 6, "auc_se", "mde")


REPLICATES = 200
WEIGHT = " ".join(f"WHEN u < '{limit}' THEN {k}.0" for k, limit in enumerate(compare.poisson_limits()))
BOOTSTRAP = f"""{PREDS}, w AS (SELECT a._row_id, a.y, a.p AS pn, b.p AS pb FROM preds a JOIN preds b USING (_row_id) WHERE a.exp_id = 'signal' AND b.exp_id = 'mix' AND a.split = 'oot_dev' AND a.y IS NOT NULL),
rk AS (SELECT *, CAST(sum(y) OVER () AS DOUBLE) AS pp, CAST(sum(1 - y) OVER () AS DOUBLE) AS nn,
  rank() OVER (ORDER BY pn) + (count(*) OVER (PARTITION BY pn) - 1) / CAST(2 AS DOUBLE) - rank() OVER (PARTITION BY y ORDER BY pn) - (count(*) OVER (PARTITION BY y, pn) - 1) / CAST(2 AS DOUBLE) AS dn,
  rank() OVER (ORDER BY pb) + (count(*) OVER (PARTITION BY pb) - 1) / CAST(2 AS DOUBLE) - rank() OVER (PARTITION BY y ORDER BY pb) - (count(*) OVER (PARTITION BY y, pb) - 1) / CAST(2 AS DOUBLE) AS db FROM w),
sh AS (SELECT _row_id, y, CASE WHEN y = 1 THEN (dn - db) / nn ELSE (db - dn) / pp END AS d FROM rk),
us AS (SELECT y, d, rep, substr(md5('0|' || (rep // 4) || '|' || _row_id), 8 * (rep % 4) + 1, 8) AS u FROM sh, range({REPLICATES}) t(rep)),
ws AS (SELECT y, d, rep, CASE {WEIGHT} ELSE 12.0 END AS wt FROM us),
point AS (SELECT avg(d) AS delta FROM sh WHERE y = 1),
reps AS (SELECT rep, sum(wt * d) FILTER (WHERE y = 1) / sum(wt) FILTER (WHERE y = 1) + sum(wt * d) FILTER (WHERE y = 0) / sum(wt) FILTER (WHERE y = 0) - max(delta) AS d FROM ws, point GROUP BY rep),
q AS (SELECT quantile_cont(d, CAST(0.05 AS DOUBLE)) AS lo, quantile_cont(d, CAST(0.95 AS DOUBLE)) AS hi FROM reps)"""


@query("paired_bootstrap", "M10,J5", f"{BOOTSTRAP} SELECT {r('delta')} AS delta, {r('lo')} AS ci_low, {r('hi')} AS ci_high, CAST(0.05 AS DOUBLE) AS alpha, lo > 0 AS significant FROM point, q")
def paired_bootstrap(spark, sf):
    pairs = compare.pair_predictions(b.preds(spark, sf).where("split = 'oot_dev'"), "signal", "mix")
    return rounded(compare.paired_bootstrap(pairs, n=REPLICATES), 6, "delta", "ci_low", "ci_high")


@query("paired_delong", "M11,J5", f"""{PREDS}, w AS (SELECT a._row_id, a.y, a.p AS pn, b.p AS pb FROM preds a JOIN preds b USING (_row_id) WHERE a.exp_id = 'signal' AND b.exp_id = 'mix' AND a.split = 'oot_dev'),
rk AS (SELECT *, sum(y) OVER () AS pp, sum(1 - y) OVER () AS nn,
  rank() OVER (ORDER BY pn) + (count(*) OVER (PARTITION BY pn) - 1) / CAST(2 AS DOUBLE) - rank() OVER (PARTITION BY y ORDER BY pn) - (count(*) OVER (PARTITION BY y, pn) - 1) / CAST(2 AS DOUBLE) AS dn,
  rank() OVER (ORDER BY pb) + (count(*) OVER (PARTITION BY pb) - 1) / CAST(2 AS DOUBLE) - rank() OVER (PARTITION BY y ORDER BY pb) - (count(*) OVER (PARTITION BY y, pb) - 1) / CAST(2 AS DOUBLE) AS db FROM w),
s AS (SELECT CAST(max(pp) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, avg(dn / nn) FILTER (WHERE y = 1) AS auc_new, avg(db / nn) FILTER (WHERE y = 1) AS auc_base,
  sqrt(var_samp((dn - db) / nn) FILTER (WHERE y = 1) / max(pp) + var_samp((dn - db) / pp) FILTER (WHERE y = 0) / max(nn)) AS se FROM rk)
SELECT n_pos, n_neg, {r('auc_new')} AS auc_new, {r('auc_base')} AS auc_base, {r('auc_new - auc_base')} AS delta, {r('se')} AS se,
       {r(f'auc_new - auc_base - {NormalDist().inv_cdf(0.95)!r} * se')} AS ci_low, {r(f'auc_new - auc_base + {NormalDist().inv_cdf(0.95)!r} * se')} AS ci_high,
       auc_new - auc_base - {NormalDist().inv_cdf(0.95)!r} * se > 0 AS significant FROM s""")
def paired_delong(spark, sf):
    pairs = compare.pair_predictions(b.preds(spark, sf).where("split = 'oot_dev'"), "signal", "mix")
    return rounded(compare.delong_paired(pairs, buckets=4), 6, "auc_new", "auc_base", "delta", "se", "ci_low", "ci_high")


TWO = "two AS (SELECT *, split = 'valid' AS ref, strftime(_obs_time, '%Y-%m') AS month FROM preds WHERE split IN ('valid', 'oot_dev'))"


@query("score_psi", "M12", f"{PREDS}, {TWO}, {psi_cte('two', 'exp_id', 'exp_id', 10, v='p')} SELECT exp_id, {r('psi')} AS psi, CASE WHEN psi > 0.25 THEN 'severe' WHEN psi > 0.1 THEN 'warn' END AS severity FROM psi_")
def score_psi(spark, sf):
    two = b.preds(spark, sf).where("split in ('valid', 'oot_dev')")
    out = m.population_shift(two, F.col("split") == "valid", ["exp_id"], buckets=4)
    return rounded(out.withColumn("severity", m.psi_severity(F.col("psi"))), 6, "psi")


@query("monthly_psi", "M12", f"{PREDS}, {TWO}, {psi_cte('two', 'exp_id', 'exp_id, month', 10, v='p')} SELECT exp_id, month, {r('psi')} AS psi FROM psi_")
def monthly_psi(spark, sf):
    two = b.preds(spark, sf).where("split in ('valid', 'oot_dev')").withColumn("month", F.date_format(OBS, "yyyy-MM"))
    return rounded(m.population_shift(two, F.col("split") == "valid", ["exp_id"], actual_by=["month"]), 6, "psi")


@query("all_metrics", "M13", f"""{PREDS}, {auc_cte('preds', 'exp_id, split')}, {curve_cte('preds', 'exp_id, split')},
c AS (SELECT exp_id, split, sum(pos / pp * tpos / (tpos + tneg)) AS pr_auc, max(abs(cpos / pp - cneg / nn)) AS ks FROM curve GROUP BY 1, 2),
g AS (SELECT exp_id, max(auc) FILTER (WHERE split = 'valid') - max(auc) FILTER (WHERE split = 'oot_dev') AS gap FROM auc_ GROUP BY 1)
SELECT exp_id, split, n_pos, n_neg, {r('auc')} AS auc, {r('pr_auc')} AS pr_auc, {r('ks')} AS ks, {r('gap')} AS gap FROM auc_ JOIN c USING (exp_id, split) JOIN g USING (exp_id)""")
def all_metrics(spark, sf):
    return rounded(m.all_metrics(b.preds(spark, sf)), 6, "auc", "pr_auc", "ks", "gap")


@query("yoy_bad_rate", "M14,S1", f"""WITH {b.CTE_MAIN}, t AS (SELECT date_trunc('month', _obs_time) AS mo, avg(CAST(_label AS DOUBLE)) AS bad_rate FROM main WHERE _label IS NOT NULL GROUP BY 1)
SELECT strftime(a.mo, '%Y-%m') AS month, {r('a.bad_rate')} AS bad_rate, {r('b.bad_rate')} AS bad_rate_last_year FROM t a LEFT JOIN t b ON b.mo = a.mo - INTERVAL 1 YEAR""")
def yoy_bad_rate(spark, sf):
    df = b.main(spark, sf).where("_label is not null")
    return rounded(m.yoy_bad_rate(df, OBS, "_label"), 6, "bad_rate", "bad_rate_last_year")


RHO_FEATURES = ["total", "n_lines", "qty_sum", "signal", "half"]


@query("spearman_direction", "M15", f"""WITH {b.CTE_SPLITS}, {long_cte('(SELECT * FROM splits WHERE split = ' + "'train'" + ')', RHO_FEATURES, extra='_label AS y')},
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / CAST(2 AS DOUBLE) AS rv,
        rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / CAST(2 AS DOUBLE) AS ry FROM long WHERE v IS NOT NULL)
SELECT feature, count(*) AS n, {r('corr(rv, ry)')} AS rho FROM k GROUP BY 1""")
def spearman_direction(spark, sf):
    train = b.splits(spark, sf).where("split = 'train'")
    dist = value_counts_by_label(train, RHO_FEATURES)
    return rounded(m.spearman_with_label(dist, ["feature"], long_buckets(train, RHO_FEATURES, 4)), 6, "rho")


@query("monthly_spread", "M16", f"""{PREDS}, monthly AS (SELECT *, strftime(_obs_time, '%Y-%m') AS month FROM preds WHERE split = 'oot_dev'), {auc_cte('monthly', 'exp_id, month')}
SELECT exp_id, {r('max(auc)')} AS auc_max, {r('min(auc)')} AS auc_min, count(*) AS n_months, {r('max(auc) - min(auc)')} AS spread, max(auc) - min(auc) > 0.05 AS risk
FROM auc_ WHERE n_pos + n_neg >= 50 AND n_pos > 0 AND n_neg > 0 GROUP BY 1""")
def monthly_spread(spark, sf):
    monthly = m.monthly_auc(b.preds(spark, sf).where("split = 'oot_dev'"), OBS, ["exp_id"], min_n=50)
    return rounded(m.monthly_spread(monthly, ["exp_id"]), 6, "auc_max", "auc_min", "spread")


SEGMENTS = ["priority", "cat"]
FIELDS = [*b.NUMERIC, *SEGMENTS]
TEXT_LONG = "CASE f.feature WHEN 'cat' THEN cat ELSE priority END AS v FROM {0}, (VALUES ('cat'), ('priority')) AS f(feature)"


@query("segment_insights", "Q17", f"""WITH {b.CTE_SPLITS}, oot AS (SELECT *, _label AS y, signal AS p FROM splits WHERE split = 'oot_dev'),
seg AS (SELECT y, p, f.feature, {TEXT_LONG.format('oot')}), {auc_cte('seg', 'feature, v')}, whole AS (SELECT 'all' AS g, y, p FROM oot), {auc_cte('whole', 'g', 'all_')},
sides AS (SELECT *, split = 'train' AS ref, CASE WHEN split = 'oot_dev' THEN strftime(_obs_time, '%Y-%m') END AS month FROM splits WHERE split IN ('train', 'oot_dev')),
{long_cte('sides', b.NUMERIC, 'numbers', 'ref, month')}, texts AS (SELECT ref, month, f.feature, {TEXT_LONG.format('sides')}),
long AS (SELECT feature, v, ref, month FROM numbers UNION ALL SELECT feature, CASE WHEN v IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY feature, v) AS DOUBLE) END, ref, month FROM texts),
{psi_cte('long', 'feature', 'feature, month', 10)},
base AS (SELECT feature, count(v) AS n_ref FROM long WHERE ref GROUP BY 1), months AS (SELECT feature, month, count(v) AS n FROM long WHERE NOT ref GROUP BY 1, 2),
drift AS (SELECT feature, month, n, coalesce(n_ref, 0) AS n_ref, psi FROM months LEFT JOIN base USING (feature) LEFT JOIN psi_ USING (feature, month)),
found AS (SELECT a.*, a.auc - w.auc AS gap, w.n_pos + w.n_neg AS n_all FROM auc_ a, all_ w)
SELECT 'segment' AS kind, feature, v AS value, n_pos + n_neg AS n, n_all AS n_ref, n_pos, n_neg, {r('auc')} AS auc, {r('gap')} AS auc_gap, CAST(NULL AS DOUBLE) AS psi, CASE WHEN n_pos + n_neg >= 200 AND gap < -0.03 THEN 'worse' END AS finding FROM found
UNION ALL SELECT 'drift', feature, month, n, n_ref, NULL, NULL, NULL, NULL, {r('psi')}, CASE WHEN n > 50 AND n_ref > 50 THEN CASE WHEN psi > 0.25 THEN 'severe' WHEN psi > 0.1 THEN 'warn' END END FROM drift""")
def segment_insights(spark, sf):
    df = b.splits(spark, sf).where("split in ('train', 'oot_dev')").withColumns({"y": F.col("_label"), "p": F.col("signal")})
    return rounded(investigate.segment_insights(df, F.col("split") == "train", SEGMENTS, FIELDS), 6, "auc", "auc_gap", "psi")
