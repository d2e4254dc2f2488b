"""Judgement, run-log and regression queries over tables derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftmill.operators import judge, regression, runlog
from siftmill.queries import bindings as b
from siftmill.queries.base import query, r, rounded, table
from siftmill.session import scratch_folder
from siftmill.streaming import live_totals

EXPS = f"WITH RECURSIVE {b.CTE_EXPS}"
LOG = f"WITH {b.CTE_LOG}"

# Metric columns of each experiment, worked out from its number k.
CAND_SQL = """cand AS (SELECT exp_id, task_id, seq, k, fidelity, 'gbt' AS model, CAST(0.5 AS DOUBLE) + CAST((k * 7) % 100 AS DOUBLE) / 300 AS valid_auc, oot_dev_auc, CAST(k * 3 % 40 AS DOUBLE) / 100 AS score_psi,
  CAST(0.03 AS DOUBLE) AS reference_gap, CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS leak_suspects, k * 5 AS best_iter, CASE WHEN k % 2 = 0 THEN 200 END AS max_iter, k % 3 AS features, k + 20 AS n_features, 50 AS n_raw_features, CAST(k AS DOUBLE) / 100 AS budget_left, k % 6 = 0 AS monotone,
  oot_dev_auc - CAST(0.45 AS DOUBLE) AS oot_dev_ks FROM exps)"""


def cand(spark, sf):
    k = F.col("k")
    return b.exps(spark, sf).select(
        "exp_id", "task_id", "seq", "k", "fidelity", F.lit("gbt").alias("model"), (0.5 + (k * 7 % 100) / 300.0).alias("valid_auc"), "oot_dev_auc", ((k * 3 % 40) / 100.0).alias("score_psi"),
        F.lit(0.03).alias("reference_gap"), F.when(k % 17 == 0, 1).otherwise(0).alias("leak_suspects"), (k * 5).alias("best_iter"), F.when(k % 2 == 0, 200).alias("max_iter"), (k % 3).alias("features"), (k + 20).alias("n_features"), F.lit(50).alias("n_raw_features"),
        (k / 100.0).alias("budget_left"), (k % 6 == 0).alias("monotone"), (F.col("oot_dev_auc") - 0.45).alias("oot_dev_ks"),
    )


CODES = """concat_ws(',', CASE WHEN valid_auc - oot_dev_auc - reference_gap > 0.05 THEN 'OVERFIT_GAP' END, CASE WHEN leak_suspects > 0 THEN 'LEAK_SUSPECT' END, CASE WHEN score_psi > 0.1 THEN 'PSI_DRIFT' END,
  CASE WHEN budget_left < 0.15 THEN 'BUDGET_LOW' END, CASE WHEN best_iter < coalesce(max_iter, 500) * 0.05 THEN 'NO_CONVERGE' END)"""


@query("diagnosis_codes", "E1", f"{EXPS}, {CAND_SQL} SELECT exp_id, {CODES} AS codes, CASE WHEN score_psi > 0.25 THEN 'severe' WHEN score_psi > 0.1 THEN 'warn' END AS psi_severity FROM cand")
def diagnosis_codes(spark, sf):
    return judge.diagnose(cand(spark, sf)).select("exp_id", F.concat_ws(",", "codes").alias("codes"), "psi_severity")


BEST_SQL = """bst AS (SELECT c.*, p.exp_id AS best_exp_id, p.oot_dev_auc AS best_oot_dev_auc, p.oot_dev_ks AS best_oot_dev_ks, p.score_psi AS best_score_psi, p.fidelity AS best_fidelity, p.monotone AS best_monotone, p.features AS best_features,
    row_number() OVER (PARTITION BY c.exp_id ORDER BY p.oot_dev_auc DESC, p.seq) AS bk
  FROM cand c LEFT JOIN cand p ON p.task_id = c.task_id AND p.seq < c.seq),
ver0 AS (SELECT *, CAST(k * 13 % 100 - 50 AS DOUBLE) / 1000 AS ci_low, CAST(k * 13 % 100 - 50 AS DOUBLE) / 1000 + CAST(0.03 AS DOUBLE) AS ci_high FROM bst WHERE bk = 1),
ver AS (SELECT *, concat_ws(',', CASE WHEN valid_auc - oot_dev_auc - reference_gap > 0.05 THEN 'OVERFIT_GAP' END, CASE WHEN leak_suspects > 0 THEN 'LEAK_SUSPECT' END, CASE WHEN n_features - n_raw_features > 40 THEN 'TOO_MANY_FEATURES' END,
    CASE WHEN score_psi > 0.25 THEN 'SCORE_PSI' END, CASE WHEN best_exp_id IS NOT NULL AND best_oot_dev_ks - oot_dev_ks > 0.2 THEN 'GUARD_FAIL' END) AS failures,
  coalesce(monotone AND features IS NOT DISTINCT FROM best_features AND NOT coalesce(best_monotone, FALSE) AND fidelity = 'full' AND best_fidelity = 'full' AND ci_high >= 0 AND score_psi < best_score_psi - 0.002, FALSE) AS noninferior FROM ver0)"""
BEST_COLUMNS = ["exp_id", "oot_dev_auc", "oot_dev_ks", "score_psi", "fidelity", "monotone", "model", "features"]


def comparisons(spark, sf):
    low = (F.col("k") * 13 % 100 - 50) / 1000.0
    best = judge.best_so_far(cand(spark, sf), BEST_COLUMNS, buckets=4)
    return best.withColumns({"ci_low": low, "ci_high": low + 0.03})


@query("verdicts", "E2,E3", f"""{EXPS}, {CAND_SQL}, {BEST_SQL} SELECT exp_id, best_exp_id, failures, concat_ws(',', nullif({CODES}, ''), CASE WHEN best_exp_id IS NOT NULL AND NOT ci_low > 0 THEN 'PLATEAU' END, CASE WHEN contains(failures, 'GUARD_FAIL') THEN 'GUARD_FAIL' END) AS codes, CASE WHEN failures <> '' THEN 'REJECT' WHEN best_exp_id IS NULL THEN CASE WHEN fidelity = 'full' THEN 'ACCEPT' ELSE 'PROMISING' END
  WHEN noninferior AND NOT ci_low > 0 THEN 'ACCEPT' WHEN ci_low > 0 THEN CASE WHEN fidelity = 'full' THEN 'ACCEPT' ELSE 'PROMISING' END WHEN ci_high < 0 THEN 'REJECT' ELSE 'INCONCLUSIVE' END AS verdict FROM ver""")
def verdicts(spark, sf):
    out = judge.verdict(comparisons(spark, sf), {"ks": 0.2})
    return out.select("exp_id", "best_exp_id", F.concat_ws(",", "failures").alias("failures"), F.concat_ws(",", "codes").alias("codes"), "verdict")


@query("monotone_noninferior", "E3", f"{EXPS}, {CAND_SQL}, {BEST_SQL} SELECT exp_id, noninferior FROM ver WHERE best_exp_id IS NOT NULL")
def monotone_noninferior(spark, sf):
    c = comparisons(spark, sf)
    return c.where("best_exp_id is not null").select("exp_id", judge.monotone_noninferior(c).alias("noninferior"))


@query("alpha_schedule", "E4", f"""{LOG}, f AS (SELECT task_id, 'c' || CAST(k % 50 AS VARCHAR) AS exp_id, min(id) AS first_use FROM log GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY first_use, exp_id) AS k FROM f)
SELECT task_id, exp_id, k, CASE WHEN k <= 30 THEN {r('0.05 / (1 + ln(k))', 9)} END AS alpha FROM n""")
def alpha_schedule(spark, sf):
    compares = b.log_fields(spark, sf).select("task_id", F.concat(F.lit("c"), (F.col("k") % 50).cast("string")).alias("exp_id"), F.col("id").alias("seq"))
    return rounded(judge.alpha_schedule(compares, buckets=4), 9, "alpha")


@query("overfit_to_oot", "E5", f"WITH {b.CTE_RUNS} SELECT dataset, seed, {r('oot_dev - holdout')} AS drop, oot_dev - holdout - CAST(0.01 AS DOUBLE) > 0.02 AS overfit FROM runs_new WHERE holdout IS NOT NULL")
def overfit_to_oot(spark, sf):
    df = b.runs(spark, sf, 1).where("holdout is not null").withColumn("reference_drop", F.lit(0.01))
    return rounded(judge.overfit_to_oot(df).select("dataset", "seed", "drop", "overfit"), 6, "drop")


MARK = "mk AS (SELECT *, CASE WHEN verdict = 'INCONCLUSIVE' AND fidelity = 'low' AND delta > 0 THEN 'INCONCLUSIVE_UP' ELSE verdict END AS mark FROM exps)"


@query("no_progress", "E6", f"""{EXPS}, {MARK}, s AS (SELECT *, CASE WHEN mark IN ('REJECT', 'INCONCLUSIVE') THEN 1 ELSE 0 END AS bad FROM mk)
SELECT exp_id, mark, bad + coalesce(lag(bad, 1) OVER w, 0) + coalesce(lag(bad, 2) OVER w, 0) = 3 AND sum(CASE WHEN verdict = 'ACCEPT' AND fidelity = 'full' THEN 1 ELSE 0 END) OVER w > 0 AS no_progress FROM s WINDOW w AS (PARTITION BY task_id ORDER BY seq)""")
def no_progress(spark, sf):
    return judge.no_progress(judge.history_mark(b.exps(spark, sf)), 3, buckets=4, chunk_rows=8, final=(F.col("verdict") == "ACCEPT") & (F.col("fidelity") == "full")).select("exp_id", "mark", "no_progress")


@query("promotable", "E7", f"{EXPS} SELECT exp_id, task_id FROM exps e WHERE fidelity = 'low' AND verdict IN ('PROMISING', 'INCONCLUSIVE') AND NOT invalidated AND NOT EXISTS (SELECT 1 FROM exps d WHERE d.action_type = 'PROMOTE_FIDELITY' AND d.target_exp_id = e.exp_id AND d.task_id = e.task_id)")
def promotable(spark, sf):
    return judge.promotable(b.exps(spark, sf)).select("exp_id", "task_id")


PROMOTABLE = "fidelity = 'low' AND verdict IN ('PROMISING', 'INCONCLUSIVE') AND NOT invalidated AND NOT EXISTS (SELECT 1 FROM exps d WHERE d.action_type = 'PROMOTE_FIDELITY' AND d.target_exp_id = e.exp_id AND d.task_id = e.task_id)"


@query("promote_candidates", "E7", f"{EXPS} SELECT exp_id, task_id FROM exps e WHERE {PROMOTABLE} AND (verdict = 'PROMISING' OR delta > 0)")
def promote_candidates(spark, sf):
    return judge.promote_candidates(b.exps(spark, sf)).select("exp_id", "task_id")


@query("decision_codes", "E7,E1", f"""{EXPS}, marked AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'OVERFIT_GAP' ELSE 'PLATEAU' END AS code, k % 4 AS left_ FROM exps),
t AS (SELECT task_id, arg_max(code, seq) AS code, arg_max(action_type, seq) AS action, arg_max(left_, seq) AS left_, bool_or(verdict = 'ACCEPT' AND fidelity = 'full' AND NOT invalidated) AS final FROM marked GROUP BY 1),
c AS (SELECT task_id, count(*) AS can, count(*) FILTER (WHERE verdict = 'PROMISING' OR delta > 0) AS wanted FROM exps e WHERE {PROMOTABLE} GROUP BY 1)
SELECT t.task_id, concat_ws(',', code, CASE WHEN NOT final AND can > 0 AND NOT (action = 'PROMOTE_FIDELITY' AND code = 'OVERFIT_GAP' AND left_ >= 2) THEN 'NO_FINAL_MODEL' END, CASE WHEN final AND wanted > 0 THEN 'PROMOTE_CANDIDATE' END) AS codes
FROM t LEFT JOIN c ON t.task_id = c.task_id""")
def decision_codes(spark, sf):
    k = F.col("k")
    e = b.exps(spark, sf).withColumns({"codes": F.array(F.when(k % 5 == 0, "OVERFIT_GAP").otherwise("PLATEAU")), "left": k % 4})
    return judge.decision_codes(e, rounds_left="left").select("task_id", F.concat_ws(",", "decision_codes").alias("codes"))


@query("top_experiments", "E8,L2", f"{EXPS}, t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY oot_dev_auc DESC, seq) AS rank FROM exps WHERE NOT invalidated) SELECT task_id, exp_id, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3")
def top_experiments(spark, sf):
    return judge.top_experiments(b.exps(spark, sf), 3).select("task_id", "exp_id", "rank")


@query("recent_rejected", "E8,L2", f"{EXPS}, t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS rank FROM exps WHERE verdict = 'REJECT') SELECT task_id, exp_id, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3")
def recent_rejected(spark, sf):
    return judge.recent_rejected(b.exps(spark, sf), 3).select("task_id", "exp_id", "rank")


@query("repeated_configs", "E8", f"{EXPS} SELECT task_id, config_hash, count(*) AS n FROM exps WHERE NOT invalidated AND fidelity <> 'none' GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_configs(spark, sf):
    return judge.repeated_configs(b.exps(spark, sf))


@query("invalidated", "E8", f"{EXPS} SELECT exp_id, invalidated OR config_hash = 'c7' AS invalidated FROM exps")
def invalidated(spark, sf):
    return judge.invalidate(b.exps(spark, sf), F.col("config_hash") == "c7").select("exp_id", "invalidated")


FINALS = "fin AS (SELECT arg_max(exp_id, seq) AS exp_id FROM exps GROUP BY task_id)"


def finals(exps):
    return exps.groupBy("task_id").agg(F.max_by("exp_id", "seq").alias("exp_id"))


@query("paths_to_root", "E8,J7", f"""{EXPS}, {FINALS}, up AS (SELECT exp_id AS start_id, exp_id, 0 AS depth FROM fin UNION ALL SELECT up.start_id, e.parent_exp_id, up.depth + 1 FROM up JOIN exps e ON e.exp_id = up.exp_id WHERE e.parent_exp_id IS NOT NULL)
SELECT start_id, exp_id, depth FROM up""")
def paths_to_root(spark, sf):
    e = cut(b.exps(spark, sf))
    return judge.lineage(e, finals(e))


def cut(df):
    from siftmill.session import cut_lineage

    return cut_lineage(df)


@query("tree_roots", "J7,R9", f"""{EXPS}, up AS (SELECT exp_id, exp_id AS root, 0 AS depth FROM exps UNION ALL SELECT up.exp_id, e.parent_exp_id, up.depth + 1 FROM up JOIN exps e ON e.exp_id = up.root WHERE e.parent_exp_id IS NOT NULL)
SELECT exp_id, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1""")
def tree_roots(spark, sf):
    return judge.roots(cut(b.exps(spark, sf)))


@query("node_deltas", "E9,J7", f"{EXPS} SELECT e.exp_id, {r('e.oot_dev_auc - p.oot_dev_auc')} AS delta FROM exps e LEFT JOIN exps p ON e.parent_exp_id = p.exp_id")
def node_deltas(spark, sf):
    e = b.exps(spark, sf).drop("delta")
    return rounded(judge.node_delta(e).select("exp_id", "delta"), 6, "delta")


PRINT_SQL = """fp AS (SELECT CAST(c_nationkey AS VARCHAR) AS task_id, c_nationkey % 2 AS side, count(*) AS n_samples, 20 + c_nationkey AS n_features, avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS bad_rate,
  avg(CASE WHEN c_acctbal < 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS missing_rate, year(max(o_orderdate)) * 12 + month(max(o_orderdate)) - year(min(o_orderdate)) * 12 - month(min(o_orderdate)) AS time_span_months
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey)"""


@query("nearest_tasks", "E10,T11", f"""WITH {PRINT_SQL}, d AS (SELECT a.task_id, s.task_id AS nearest, sqrt(pow((log10(a.n_samples) - log10(s.n_samples)) / 0.5, 2) + pow((a.n_features - s.n_features) / 20.0, 2) + pow((a.bad_rate - s.bad_rate) / 0.05, 2) + pow((a.missing_rate - s.missing_rate) / 0.1, 2) + pow((a.time_span_months - s.time_span_months) / 12.0, 2)) AS distance
  FROM fp a, fp s WHERE a.side = 0 AND s.side = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY distance, nearest) AS rk FROM d)
SELECT task_id, CASE WHEN distance <= 2 THEN nearest END AS nearest, {r('distance')} AS distance, distance > 2 AS cold_start FROM n WHERE rk = 1""")
def nearest_tasks(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    months = lambda c: F.year(c) * 12 + F.month(c)
    fp = j.groupBy("c_nationkey").agg(
        F.count("*").alias("n_samples"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("bad_rate"), F.avg((F.col("c_acctbal") < 0).cast("double")).alias("missing_rate"),
        (months(F.max("o_orderdate")) - months(F.min("o_orderdate"))).alias("time_span_months"),
    ).withColumns({"task_id": F.col("c_nationkey").cast("string"), "n_features": F.col("c_nationkey") + 20})
    side = F.col("c_nationkey") % 2
    return rounded(judge.nearest_tasks(fp.where(side == 0), fp.where(side == 1)), 6, "distance")


SHARE_SQL = """sh AS (SELECT o_orderpriority AS feature, 'x' || CAST(o_custkey % 4 AS VARCHAR) AS exp_id, CAST(count(*) FILTER (WHERE o_orderkey % (1 + length(o_orderpriority) % 5) = 0) AS DOUBLE) AS w, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) - CAST(0.34 AS DOUBLE) AS c0 FROM orders GROUP BY 1, 2),
ct AS (SELECT exp_id, feature, w / sum(w) OVER (PARTITION BY exp_id) AS share, c0 * 10 AS corr, CASE feature WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN -1 WHEN '5-LOW' THEN 0 ELSE NULL END AS prior, feature = '3-MEDIUM' AS incumbent FROM sh)"""


def contribution_table(spark, sf):
    o = table(spark, sf, "orders")
    step = 1 + F.length("o_orderpriority") % 5
    sh = o.groupBy(F.col("o_orderpriority").alias("feature"), F.concat(F.lit("x"), (F.col("o_custkey") % 4).cast("string")).alias("exp_id")).agg(
        F.count_if(F.col("o_orderkey") % step == 0).cast("double").alias("w"), (F.count_if(F.col("o_orderstatus") == "F").cast("double") / F.count("*") - 0.34).alias("c0"))
    tot = sh.groupBy("exp_id").agg(F.sum("w").alias("_all"))
    prior = F.when(F.col("feature") == "1-URGENT", 1).when(F.col("feature") == "2-HIGH", -1).when(F.col("feature") == "5-LOW", 0)
    return sh.join(tot, "exp_id").select("exp_id", "feature", (F.col("w") / F.col("_all")).alias("share"), (F.col("c0") * 10).alias("corr"), prior.alias("prior"), (F.col("feature") == "3-MEDIUM").alias("incumbent"))


@query("sanity_flags", "E11", f"WITH {SHARE_SQL} SELECT exp_id, feature, {r('share')} AS share, coalesce(prior <> 0 AND abs(corr) > 0.1 AND sign(corr) <> sign(prior) AND share >= 0.01, FALSE) AS against_prior, share > 0.25 AS dominates FROM ct")
def sanity_flags(spark, sf):
    return rounded(judge.sanity_flags(contribution_table(spark, sf), max_share=0.25), 6, "share").select("exp_id", "feature", "share", "against_prior", "dominates")


@query("incumbent_share", "E11", f"WITH {SHARE_SQL} SELECT exp_id, {r('sum(share) FILTER (WHERE incumbent)')} AS incumbent_share FROM ct GROUP BY 1")
def incumbent_share(spark, sf):
    return rounded(judge.incumbent_share(contribution_table(spark, sf)), 6, "incumbent_share")


@query("race_ties", "ML9", f"""{EXPS}, s AS (SELECT task_id, action_type AS model, max(oot_dev_auc) AS score FROM exps GROUP BY 1, 2), m AS (SELECT *, max(score) OVER (PARTITION BY task_id) AS top, first_value(model) OVER (PARTITION BY task_id ORDER BY score DESC, model DESC) AS best FROM s),
t AS (SELECT *, CASE model WHEN 'TUNE' THEN 0 WHEN 'RACE' THEN 1 ELSE 2 END AS place FROM m WHERE top - score < CAST(0.05 AS DOUBLE) OR model = best)
SELECT task_id, arg_min(model, (place, -score, model)) AS recommended, count(*) AS n_tied, max(best) AS best FROM t GROUP BY 1""")
def race_ties(spark, sf):
    s = b.exps(spark, sf).groupBy("task_id", F.col("action_type").alias("model")).agg(F.max("oot_dev_auc").alias("score"))
    return judge.race_tie(s, 0.05, ["TUNE", "RACE"])


# ---- run log --------------------------------------------------------------------------------

SEG = """seg AS (SELECT *, count(*) FILTER (WHERE to_state = 'DECIDE') OVER w AS segment, count(*) FILTER (WHERE to_state = 'FINAL_GATE') OVER w > 0 AS finale FROM log
  WINDOW w AS (PARTITION BY task_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sg AS (SELECT *, CASE WHEN finale THEN 'finale' WHEN segment = 0 THEN 'setup' ELSE 'round' END AS kind FROM seg)"""


@query("event_segments", "R1", f"{LOG}, {SEG} SELECT id, task_id, segment, kind FROM sg")
def event_segments(spark, sf):
    return runlog.segment_events(b.runlog(spark, sf), buckets=8).select("id", "task_id", F.col("segment").cast("long").alias("segment"), "kind")


@query("round_rows", "R2", f"""{LOG}, {SEG} SELECT task_id, segment, kind, arg_max(exp_id, id) FILTER (WHERE type = 'recorded') AS exp_id, arg_max(verdict, id) FILTER (WHERE type = 'recorded') AS verdict,
  {r("arg_max(delta, id) FILTER (WHERE type = 'evaluated')")} AS delta, count(*) FILTER (WHERE type = 'llm_call') AS n_calls, count(*) FILTER (WHERE type = 'decision_rejected') AS n_rejected,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, max(ts) - min(ts) AS seconds, count(*) AS n_events FROM sg GROUP BY 1, 2, 3""")
def round_rows(spark, sf):
    rows = runlog.round_rows(runlog.segment_events(b.runlog(spark, sf)))
    return rounded(rows.drop("action").withColumn("segment", F.col("segment").cast("long")), 6, "delta")


@query("task_summaries", "R3", f"""{LOG}, {SEG} SELECT task_id, CAST(coalesce(max(segment) FILTER (WHERE kind = 'round'), 0) AS BIGINT) AS n_rounds, count(*) FILTER (WHERE type = 'llm_call') AS n_calls, count(*) FILTER (WHERE type = 'llm_call' AND k = 13) AS n_errors,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE type = 'decision_rejected') AS n_rejected, count(*) FILTER (WHERE type = 'recorded' AND verdict = 'ACCEPT') AS n_accept, count(*) FILTER (WHERE type = 'recorded' AND verdict = 'REJECT') AS n_reject,
  count(*) FILTER (WHERE type = 'recorded' AND verdict = 'PROMISING') AS n_promising, count(*) FILTER (WHERE type = 'recorded' AND verdict = 'INCONCLUSIVE') AS n_inconclusive, arg_max(to_state, id) FILTER (WHERE type = 'state_transition') AS final_state FROM sg GROUP BY 1""")
def task_summaries(spark, sf):
    return runlog.summarize(runlog.segment_events(b.runlog(spark, sf))).drop("stop_reason")


PRICE = {"input_cache_hit": 0.0028, "input_cache_miss": 0.14, "output": 0.28}
USAGE_SQL = """us AS (SELECT task_id, count(*) AS calls, CAST(sum(CASE WHEN itemised THEN k ELSE 0 END) AS BIGINT) AS input_cache_hit, CAST(sum(CASE WHEN itemised THEN 2 * k ELSE tokens END) AS BIGINT) AS input_cache_miss,
  CAST(sum(CASE WHEN itemised THEN k + 1 ELSE 0 END) AS BIGINT) AS output, CAST(0 AS BIGINT) AS reasoning FROM log WHERE type = 'llm_call' GROUP BY 1)"""


@query("usage_costs", "R4", f"{LOG}, {USAGE_SQL} SELECT *, {r('(input_cache_hit * CAST(0.0028 AS DOUBLE) + input_cache_miss * CAST(0.14 AS DOUBLE) + output * CAST(0.28 AS DOUBLE)) / 1000000', 12)} AS cost_usd FROM us")
def usage_costs(spark, sf):
    return rounded(runlog.usage_totals(b.runlog(spark, sf), PRICE), 12, "cost_usd")


@query("wall_seconds", "R5", f"{LOG} SELECT task_id, {r('sum(sec)')} AS wall_sec FROM log WHERE type = 'state_transition' GROUP BY 1")
def wall_seconds(spark, sf):
    return rounded(runlog.wall_seconds(b.runlog(spark, sf)), 6, "wall_sec")


@query("wasted_rounds", "R6", f"""{EXPS}, f AS (SELECT *, CASE WHEN fidelity <> 'none' THEN row_number() OVER (PARTITION BY task_id, config_hash, fidelity <> 'none' ORDER BY seq) END AS nth FROM exps)
SELECT task_id, count(*) FILTER (WHERE action_type <> 'RACE') AS n_rounds, count(*) FILTER (WHERE action_type <> 'RACE' AND (failed_code OR coalesce(nth > 1, FALSE))) AS n_wasted,
  {r("CAST(count(*) FILTER (WHERE action_type <> 'RACE' AND (failed_code OR coalesce(nth > 1, FALSE))) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE action_type <> 'RACE'), 0)")} AS wasted_rate FROM f GROUP BY 1""")
def wasted_rounds(spark, sf):
    return rounded(runlog.wasted_rounds(b.exps(spark, sf)), 6, "wasted_rate")


@query("rejections_by_kind", "R7", f"{LOG} SELECT task_id, CASE k % 5 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'template' WHEN 2 THEN 'budget' WHEN 3 THEN 'format' ELSE 'other' END AS kind, count(*) AS n FROM log WHERE type = 'decision_rejected' GROUP BY 1, 2")
def rejections_by_kind(spark, sf):
    return runlog.rejected_by_kind(b.runlog(spark, sf))


@query("upgrade_rates", "R8", f"""{EXPS}, rec AS (SELECT task_id, exp_id, id AS at_, worth FROM log WHERE type = 'recorded'), acc AS (SELECT task_id, min(seq) AS a FROM exps WHERE verdict = 'ACCEPT' GROUP BY 1), lst AS (SELECT task_id, max(at_) AS l FROM rec GROUP BY 1),
m AS (SELECT e.*, coalesce(e.action_type <> 'RACE' AND r.worth AND r.at_ < l.l, FALSE) AS worthy, EXISTS (SELECT 1 FROM exps d WHERE d.action_type = 'PROMOTE_FIDELITY' AND d.task_id = e.task_id AND d.target_exp_id = e.exp_id) AS done
  FROM exps e JOIN acc ON e.task_id = acc.task_id AND e.seq > acc.a LEFT JOIN rec r ON r.exp_id = e.exp_id AND r.task_id = e.task_id LEFT JOIN lst l ON l.task_id = e.task_id),
c AS (SELECT task_id, count(*) FILTER (WHERE worthy) AS n_worth, count(*) FILTER (WHERE worthy AND done) AS n_promoted, count(*) FILTER (WHERE action_type = 'PROMOTE_FIDELITY') AS n_upgrades, count(*) FILTER (WHERE action_type = 'PROMOTE_FIDELITY' AND verdict = 'ACCEPT') AS n_upgrades_ok FROM m GROUP BY 1)
SELECT *, {r('CAST(n_promoted AS DOUBLE) / NULLIF(n_worth, 0)')} AS upgrade_hit_rate, {r('CAST(n_upgrades_ok AS DOUBLE) / NULLIF(n_upgrades, 0)')} AS upgrade_success_rate FROM c""")
def upgrade_rates(spark, sf):
    rec = runlog.parse_payload(b.runlog(spark, sf)).where("type = 'recorded'").select("task_id", "exp_id", F.col("id").alias("at"), F.col("pl.worth").alias("worth"))
    return rounded(runlog.upgrade_rates(b.exps(spark, sf).drop("worth"), rec), 6, "upgrade_hit_rate", "upgrade_success_rate")


@query("final_lineage", "R9,J7", f"""{EXPS}, {FINALS}, up AS (SELECT exp_id AS start_id, exp_id, 0 AS depth FROM fin UNION ALL SELECT up.start_id, e.parent_exp_id, up.depth + 1 FROM up JOIN exps e ON e.exp_id = up.exp_id WHERE e.parent_exp_id IS NOT NULL)
SELECT start_id, max(depth) OVER (PARTITION BY start_id) - depth AS step, up.exp_id, action_type FROM up JOIN exps e ON e.exp_id = up.exp_id""")
def final_lineage(spark, sf):
    e = cut(b.exps(spark, sf))
    return runlog.final_lineage(e, finals(e))


@query("feature_funnel", "R9", f"""{EXPS}, w AS (SELECT task_id, target_exp_id AS exp_id, bool_or(verdict = 'ACCEPT') AS won FROM exps WHERE action_type = 'PROMOTE_FIDELITY' AND target_exp_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT e.*, won FROM exps e LEFT JOIN w USING (task_id, exp_id))
SELECT task_id, count(*) FILTER (WHERE action_type = 'EXPAND_FEATURES') AS attempts, count(*) FILTER (WHERE action_type = 'EXPAND_FEATURES' AND n_kept > 0) AS kept, count(*) FILTER (WHERE action_type = 'EXPAND_FEATURES' AND n_kept > 0 AND worth) AS promising,
  count(*) FILTER (WHERE action_type = 'EXPAND_FEATURES' AND n_kept > 0 AND worth AND won IS NOT NULL) AS promoted, count(*) FILTER (WHERE action_type = 'EXPAND_FEATURES' AND n_kept > 0 AND worth AND won) AS accepted FROM m GROUP BY 1""")
def feature_funnel(spark, sf):
    return runlog.feature_funnel(b.exps(spark, sf))


@query("recovery_rate", "R10", f"""{EXPS}, o AS (SELECT task_id, verdict = 'REJECT' OR failed_code AS bad, action_type || '|' || params AS move, lead(action_type || '|' || params) OVER (PARTITION BY task_id ORDER BY seq) AS nxt FROM exps WHERE action_type <> 'RACE')
SELECT task_id, count(*) FILTER (WHERE bad AND nxt IS NOT NULL) AS n_failures, count(*) FILTER (WHERE bad AND nxt <> move) AS n_changed, {r('CAST(count(*) FILTER (WHERE bad AND nxt <> move) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE bad AND nxt IS NOT NULL), 0)')} AS recovery FROM o GROUP BY 1""")
def recovery_rate(spark, sf):
    return rounded(runlog.recovery(b.exps(spark, sf), buckets=4), 6, "recovery")


# ---- versions -------------------------------------------------------------------------------

RUNS = f"WITH {b.CTE_RUNS}"


@query("version_summary", "R11,A5", f"""{RUNS} SELECT r.dataset, count(*) AS n, count(holdout) AS n_ok, {r('avg(holdout)')} AS holdout_mean, {r('avg(holdout - holdout_auc)')} AS delta_b1_mean, arg_min(seed, (CASE WHEN holdout IS NULL THEN 0 ELSE 1 END, coalesce(holdout, 0), seed)) AS worst_seed,
  count(*) FILTER (WHERE fe_in_final > 0) AS n_fe_in_final, {r('sum(wall_sec)')} AS wall_sec, {r('sum(cost_usd)')} AS cost_usd FROM runs_new r JOIN base_new b ON r.dataset = b.dataset AND b.name = 'b1' GROUP BY 1""")
def version_summary(spark, sf):
    return rounded(regression.version_summary(b.runs(spark, sf, 1), b.baselines(spark, sf, 1)), 6, "holdout_mean", "delta_b1_mean", "wall_sec", "cost_usd")


@query("merged_runs", "S2", f"{RUNS} SELECT dataset, seed, status, holdout FROM runs_old WHERE (dataset, seed) NOT IN (SELECT (dataset, seed) FROM runs_new WHERE seed < 2) UNION ALL SELECT dataset, seed, status, holdout FROM runs_new WHERE seed < 2")
def merged_runs(spark, sf):
    return regression.merge_runs(b.runs(spark, sf, 0), b.runs(spark, sf, 1).where("seed < 2")).select("dataset", "seed", "status", "holdout")


METRIC_ROWS = " UNION ALL ".join(
    f"SELECT a.dataset, a.seed, '{m}' AS metric, {e.format('a', 'ba')} AS x, {e.format('o', 'bo')} AS y FROM runs_new a JOIN runs_old o ON a.dataset = o.dataset AND a.seed = o.seed JOIN base_new ba ON ba.dataset = a.dataset AND ba.name = 'b1' JOIN base_old bo ON bo.dataset = a.dataset AND bo.name = 'b1'"
    for m, e in {"holdout": "{0}.holdout", "delta_b1": "{0}.holdout - {1}.holdout_auc", "wasted_rate": "{0}.wasted_rate", "rejected_decisions": "{0}.rejected_decisions", "upgrade_hit_rate": "{0}.upgrade_hit_rate", "fe_in_final": "{0}.fe_in_final"}.items())
BAND_SQL = "CASE metric " + " ".join(f"WHEN '{m}' THEN CAST({v} AS DOUBLE)" for m, v in regression.DEFAULT_BANDS.items()) + " END"
UP_SQL = "metric IN ('holdout', 'delta_b1', 'upgrade_hit_rate', 'fe_in_final')"


@query("regression_compare", "R12,J5", f"""{RUNS}, mr AS ({METRIC_ROWS}), d AS (SELECT *, x - y AS d FROM mr WHERE x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT dataset, metric, avg(d) AS delta, avg(x) AS xm, avg(y) AS ym, count(*) AS n, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, arg_min(seed, (d, seed)) AS lo, arg_min(seed, (-d, seed)) AS hi FROM d GROUP BY 1, 2),
v AS (SELECT *, abs(delta) > {BAND_SQL} AND (CASE WHEN delta > 0 THEN up WHEN delta < 0 THEN down ELSE 0 END) >= (CASE WHEN n <= 2 THEN n ELSE ceil(2 * n / 3.0) END) AS moved FROM g)
SELECT dataset, metric, {r('delta')} AS delta, {r('xm')} AS new, {r('ym')} AS old, n, CASE WHEN NOT moved THEN 'same' WHEN (delta > 0) = ({UP_SQL}) THEN 'better' ELSE 'worse' END AS verdict, CASE WHEN {UP_SQL} THEN lo ELSE hi END AS worst_seed FROM v""")
def regression_compare(spark, sf):
    new = regression.with_gain(b.runs(spark, sf, 1), b.baselines(spark, sf, 1))
    old = regression.with_gain(b.runs(spark, sf, 0), b.baselines(spark, sf, 0))
    return rounded(regression.regression_compare(new, old), 6, "delta", "new", "old")


@query("hard_flags", "R13", f"""{RUNS}, x AS (SELECT r.*, oot_dev - holdout - (SELECT max(oot_dev_auc - holdout_auc) FROM base_new b WHERE b.dataset = r.dataset AND b.name = 'b0') AS ex FROM runs_new r),
xo AS (SELECT r.*, oot_dev - holdout - (SELECT max(oot_dev_auc - holdout_auc) FROM base_old b WHERE b.dataset = r.dataset AND b.name = 'b0') AS ex FROM runs_old r),
c AS (SELECT a.dataset, sum(a.wall_sec) AS wn, sum(o.wall_sec) AS wo, sum(a.cost_usd) AS cn, sum(o.cost_usd) AS co FROM runs_new a JOIN runs_old o ON a.dataset = o.dataset AND a.seed = o.seed GROUP BY 1)
SELECT 'failed_run' AS kind, dataset, seed, 'no final model' AS detail FROM runs_new WHERE status <> 'ok' OR holdout IS NULL
UNION ALL SELECT 'overfit', dataset, seed, 'holdout drops more than the baseline''s' FROM x WHERE ex > 0.02 AND NOT EXISTS (SELECT 1 FROM xo WHERE xo.dataset = x.dataset AND xo.seed = x.seed AND xo.ex > 0.02)
UNION ALL SELECT 'new_reject_kind', dataset, seed, 'kind' || CAST(CAST(rejected_decisions AS INTEGER) AS VARCHAR) FROM runs_new n WHERE NOT EXISTS (SELECT 1 FROM runs_old o WHERE o.dataset = n.dataset AND o.seed = n.seed AND o.rejected_decisions = n.rejected_decisions)
UNION ALL SELECT CASE WHEN o.wall_sec IS NULL THEN 'scenario_failed' ELSE 'scenario_regressed' END, n.dataset, NULL, 's' || CAST(n.seed AS VARCHAR) FROM runs_new n LEFT JOIN runs_old o ON o.dataset = n.dataset AND o.seed = n.seed AND o.seed > 0 WHERE NOT n.upgrade_hit_rate > 0.33 AND (o.wall_sec IS NULL OR o.upgrade_hit_rate > 0.33)
UNION ALL SELECT 'cost_up', dataset, NULL, 'wall_sec' FROM c WHERE wo > 0 AND wn > 1.3 * wo UNION ALL SELECT 'cost_up', dataset, NULL, 'cost_usd' FROM c WHERE co > 0 AND cn > 1.3 * co""")
def hard_flags(spark, sf):
    new, old = b.runs(spark, sf, 1), b.runs(spark, sf, 0)
    kinds = lambda df: df.select("dataset", "seed", F.concat(F.lit("kind"), F.col("rejected_decisions").cast("int").cast("string")).alias("reject_kind"))
    scen = lambda df: df.select(F.concat(F.lit("s"), F.col("seed").cast("string")).alias("scenario"), F.col("dataset").alias("base"), (F.col("upgrade_hit_rate") > 0.33).alias("passed"))
    return regression.hard_flags(new, old, b.baselines(spark, sf, 1), b.baselines(spark, sf, 0), kinds(new), kinds(old), scen(new), scen(old.where("seed > 0")))


@query("noise_bands", "R14", f"""{RUNS}, mr AS ({METRIC_ROWS}) SELECT dataset, metric, count(*) AS n, {r(f'greatest(round(max(abs(x - y)), 4), {BAND_SQL})')} AS band FROM mr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")
def noise_bands(spark, sf):
    new = regression.with_gain(b.runs(spark, sf, 1), b.baselines(spark, sf, 1))
    old = regression.with_gain(b.runs(spark, sf, 0), b.baselines(spark, sf, 0))
    return rounded(regression.calibrate_noise(new, old), 6, "band")


@query("cost_thresholds", "R14", f"""{RUNS}, c AS (SELECT a.dataset, u.key, sum(CASE u.key WHEN 'wall_sec' THEN a.wall_sec ELSE a.cost_usd END) AS x, sum(CASE u.key WHEN 'wall_sec' THEN o.wall_sec ELSE o.cost_usd END) AS y
  FROM runs_new a JOIN runs_old o ON a.dataset = o.dataset AND a.seed = o.seed, (VALUES ('wall_sec'), ('cost_usd')) AS u(key) GROUP BY 1, 2)
SELECT dataset, key, ceil(round(100 * greatest(CAST(1.3 AS DOUBLE), coalesce(x / NULLIF(y, 0), 0), coalesce(y / NULLIF(x, 0), 0)), 9)) / 100 AS ratio FROM c""")
def cost_thresholds(spark, sf):
    return regression.calibrate_cost(b.runs(spark, sf, 1), b.runs(spark, sf, 0))


@query("leak_scenario", "R15", f"""{EXPS}, f AS (SELECT task_id, max(oot_dev_auc) AS holdout FROM exps GROUP BY 1), u AS (SELECT DISTINCT task_id FROM exps WHERE verdict = 'ACCEPT' AND k % 50 = 0), q AS (SELECT DISTINCT task_id FROM exps WHERE k % 4 = 1),
z AS (SELECT f.task_id, CASE WHEN f.task_id IN (SELECT task_id FROM u) THEN 'leak_used' WHEN f.task_id NOT IN (SELECT task_id FROM q) THEN 'not_quarantined' WHEN holdout > CAST(0.69 AS DOUBLE) + CAST(0.05 AS DOUBLE) THEN 'holdout_too_good' END AS reason FROM f)
SELECT task_id, reason IS NULL AS passed, reason FROM z""")
def leak_scenario(spark, sf):
    e = b.exps(spark, sf).withColumn("features", F.when(F.col("k") % 50 == 0, F.array(F.lit("leak"))).otherwise(F.array(F.lit("x"))))
    fin = e.groupBy("task_id").agg(F.max("oot_dev_auc").alias("holdout")).withColumn("baseline", F.lit(0.69))
    quarantined = e.where("k % 4 = 1").select("task_id", F.lit("leak").alias("column"))
    return runlog.leak_scenario(e, quarantined, fin, "leak")


@query("no_signal_scenario", "R15", f"{EXPS}, f AS (SELECT task_id, avg(oot_dev_auc) - CAST(0.1 AS DOUBLE) AS holdout FROM exps GROUP BY 1) SELECT task_id, holdout - 0.5 <= 0.02 AS passed, {r('holdout - 0.5')} AS gap FROM f")
def no_signal_scenario(spark, sf):
    # Added in the order of the experiments: the last bits decide at the tolerance and when rounding.
    so_far = F.sum("oot_dev_auc").over(Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.max_by("_sum", "seq") / F.count("oot_dev_auc")
    fin = b.exps(spark, sf).withColumn("_sum", so_far).groupBy("task_id").agg((total - 0.1).alias("holdout"))
    return rounded(runlog.no_signal_scenario(fin, tolerance=0.02), 6, "gap")


@query("small_oot_scenario", "R15", f"""{LOG} SELECT task_id, coalesce(bool_or(type = 'recorded' AND k = 50), FALSE) AS underpowered, count(*) FILTER (WHERE type = 'evaluated' AND verdict = 'ACCEPT' AND NOT significant) AS n_insignificant_accepts,
  coalesce(bool_or(type = 'recorded' AND k = 50), FALSE) AND count(*) FILTER (WHERE type = 'evaluated' AND verdict = 'ACCEPT' AND NOT significant) = 0 AS passed FROM log GROUP BY 1""")
def small_oot_scenario(spark, sf):
    mark = b.log_fields(spark, sf).where("type = 'recorded' and k = 50").select(F.col("id"), "task_id", "ts", F.lit("oot_power").alias("type"), F.lit(None).cast("string").alias("exp_id"), F.lit('{"underpowered": true}').alias("payload"))
    return runlog.small_oot_scenario(b.runlog(spark, sf).unionByName(mark))


@query("live_run_totals", "ST1,R3,R4", f"""{LOG} SELECT task_id, type, count(*) AS n, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(CASE WHEN itemised THEN k END), 0) AS BIGINT) AS input_cache_hit, CAST(coalesce(sum(CASE WHEN itemised THEN 2 * k END), 0) AS BIGINT) AS input_cache_miss,
  CAST(coalesce(sum(CASE WHEN itemised THEN k + 1 END), 0) AS BIGINT) AS output, CAST(0 AS BIGINT) AS reasoning, {r('coalesce(sum(sec), 0)')} AS sec FROM log GROUP BY 1, 2""")
def live_run_totals(spark, sf):
    """Streams the log files through the running totals and returns the final state."""
    root = scratch_folder(spark, "totals")
    log = b.runlog(spark, sf)
    log.repartition(4, "id").write.parquet(f"{root}/log")
    stream = live_totals.read_event_stream(spark, f"{root}/log", log.schema, files_per_trigger=2)
    q = live_totals.write_totals(live_totals.run_totals(stream), f"{root}/table", f"{root}/checkpoint").start()
    q.awaitTermination()
    return rounded(live_totals.read_totals(spark, f"{root}/table"), 6, "sec")
