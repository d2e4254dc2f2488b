"""Model queries: WOE and monotone rules are checked by SQL, fitted models by their row counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.columns import ID, SPLIT
from siftmill.operators import explain, factory, judge, metrics, models, registry, stored
from siftmill.operators import user_code as user_code_sets
from siftmill.operators.models import Inputs
from siftmill.queries import bindings as b
from siftmill.queries.base import query, r, rounded, table
from siftmill.queries.screening import AUCS, BINS, IV
from siftmill.queries.sqltext import edges_cte, long_cte, psi_cte, right_bin
from siftmill.session import cut_lineage, scratch_folder

INPUTS = Inputs(numeric=("total", "n_lines", "qty_sum", "signal", "half"), categorical=("cat",))
SMALL = {"gbt": {"max_iter": 5, "max_depth": 3}, "random_forest": {"n_trees": 8, "max_depth": 4}, "scorecard": {"C": 1.0, "n_bins": 8}}


def rows(spark, sf):
    """The split table, written once: every fit scans it several times."""
    return cut_lineage(b.splits(spark, sf).select(ID, "_label", "_obs_time", SPLIT, *INPUTS.names, "price_max", "disc_min"), (SPLIT,))


def summary(preds):
    return preds.groupBy("exp_id", SPLIT).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


WOE_FEATURES = list(INPUTS.numeric)
WOE_SQL = f"""WITH {b.CTE_SPLITS}, train AS (SELECT *, _label AS y FROM splits WHERE split = 'train'), {long_cte('train', WOE_FEATURES, extra='_row_id, y')}, {edges_cte('long', 'feature', 10)},
bn AS (SELECT l._row_id, l.feature, y, CASE WHEN v IS NULL THEN -1 WHEN len(edges) < 3 THEN 0 ELSE {right_bin('edges', 'v')} END AS bin, NULL AS level FROM long l JOIN edges e ON l.feature = e.feature),
lv AS (SELECT cat, count(*) AS n FROM train WHERE cat IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
cb AS (SELECT _row_id, 'cat' AS feature, y, NULL AS bin, CASE WHEN cat IN (SELECT cat FROM lv) THEN cat ELSE '__rare__' END AS level FROM train),
al AS (SELECT _row_id, feature, y, CAST(bin AS INTEGER) AS bin, CAST(level AS VARCHAR) AS level FROM bn UNION ALL SELECT _row_id, feature, y, CAST(bin AS INTEGER), level FROM cb),
g AS (SELECT feature, bin, level, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM al GROUP BY 1, 2, 3),
s AS (SELECT *, CAST(sum(n_pos) OVER (PARTITION BY feature) AS DOUBLE) / sum(n) OVER (PARTITION BY feature) AS rate FROM g),
wt AS (SELECT feature, bin, level, n, n_pos, ln(((n_pos + 2 * rate) / sum(n_pos + 2 * rate) OVER (PARTITION BY feature)) / ((n - n_pos + 2 * (1 - rate)) / sum(n - n_pos + 2 * (1 - rate)) OVER (PARTITION BY feature))) AS woe FROM s)"""


@query("woe_table", "ML2", f"{WOE_SQL} SELECT feature, bin, level, n, n_pos, {r('woe')} AS woe FROM wt")
def woe_table(spark, sf):
    train = rows(spark, sf).where("split = 'train'")
    return rounded(models.woe_table(train, INPUTS, 10, buckets=4).select("feature", "bin", "level", "n", "n_pos", "woe"), 6, "woe")


@query("woe_transform", "ML3", f"""{WOE_SQL} SELECT al._row_id, {', '.join(f"{r(f'''max(woe) FILTER (WHERE al.feature = '{f}')''')} AS {f}__woe" for f in INPUTS.names)}
FROM al JOIN wt ON al.feature = wt.feature AND al.bin IS NOT DISTINCT FROM wt.bin AND al.level IS NOT DISTINCT FROM wt.level GROUP BY 1""")
def woe_transform(spark, sf):
    train = rows(spark, sf).where("split = 'train'")
    fitted = cut_lineage(models.woe_table(train, INPUTS, 10))
    names = [f"{f}__woe" for f in INPUTS.names]
    return rounded(models.woe_transform(train, INPUTS, fitted).select(ID, *names), 6, *names)


TRAIN_SQL = f"WITH {b.CTE_SPLITS}, levels AS (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS code FROM (SELECT DISTINCT cat FROM splits WHERE split = 'train' AND cat IS NOT NULL))"


@query("encoded_rows", "ML1", f"""{TRAIN_SQL}, coded AS (SELECT split, coalesce(code, (SELECT count(*) FROM levels)) AS code FROM splits LEFT JOIN levels ON splits.cat = levels.cat)
SELECT split, CAST(code AS INTEGER) AS code, count(*) AS n FROM coded GROUP BY 1, 2""")
def encoded_rows(spark, sf):
    """Frozen levels and medians: unseen categories get the extra code."""
    s = rows(spark, sf)
    enc = models.fit_encoder(s.where("split = 'train'"), INPUTS)
    return enc.transform(s).groupBy(SPLIT, F.col("cat__code").cast("int").alias("code")).agg(F.count("*").alias("n"))


@query("frozen_medians", "ML1", f"WITH {b.CTE_SPLITS}, train AS (SELECT * FROM splits WHERE split = 'train'), {long_cte('train', list(INPUTS.numeric))} SELECT feature, {r('quantile_cont(v, CAST(0.5 AS DOUBLE))')} AS median FROM long WHERE v IS NOT NULL GROUP BY 1")
def frozen_medians(spark, sf):
    enc = models.fit_encoder(rows(spark, sf).where("split = 'train'"), INPUTS, buckets=4)
    return rounded(spark.createDataFrame(sorted(enc.medians.items()), "feature string, median double"), 6, "median")


MANY = Inputs(numeric=("total", "signal"), categorical=("cust_id", "cat"))


def many_rows(spark, sf):
    """The split table with the customer as a category of very many levels."""
    return cut_lineage(b.splits(spark, sf).select(ID, "_label", "_obs_time", SPLIT, "total", "signal", "cat", F.concat(F.lit("c"), F.col("cust").cast("string")).alias("cust_id")), (SPLIT,))


_FOLD = "(CAST('0x' || substr(md5('fold|' || CAST(_row_id AS VARCHAR)), 1, 8) AS BIGINT) % 5)"


@query("target_statistics", "ML1,ML5,ML6", f"""WITH {b.CTE_SPLITS}, t AS (SELECT *, {_FOLD} AS fold FROM splits),
prior AS (SELECT avg(CAST(_label AS DOUBLE)) AS p FROM t WHERE split = 'train'),
lv AS (SELECT cust, fold, count(*) AS n, sum(_label) AS pos FROM t WHERE split = 'train' GROUP BY 1, 2),
j AS (SELECT t._row_id, t.split, sum(coalesce(lv.n, 0)) FILTER (WHERE NOT (t.split = 'train' AND lv.fold = t.fold)) AS n, sum(lv.pos) FILTER (WHERE NOT (t.split = 'train' AND lv.fold = t.fold)) AS pos FROM t LEFT JOIN lv ON t.cust = lv.cust GROUP BY 1, 2)
SELECT _row_id, split, {r('(coalesce(pos, 0) + 20 * p) / (coalesce(n, 0) + 20)')} AS cust_rate FROM j, prior""")
def target_statistics(spark, sf):
    """Event rate of each row's customer, a training row's own fold left out."""
    s = many_rows(spark, sf)
    enc = models.fit_encoder(s.where("split = 'train'"), MANY)
    return rounded(enc.transform(s).select(ID, SPLIT, F.col("cust_id__rate").alias("cust_rate")), 6, "cust_rate")


@query("many_levels", "ML5,ML6")
def many_levels(spark, sf):
    """Both tree models with a category of very many levels."""
    s = many_rows(spark, sf)
    out = [summary(models.run_experiment(name, name, s, MANY, SMALL[name])[1]) for name in ("gbt", "random_forest")]
    return out[0].unionByName(out[1])


@query("scorecard", "ML4,ML7")
def scorecard(spark, sf):
    return summary(models.run_experiment("card", "scorecard", rows(spark, sf), INPUTS, SMALL["scorecard"])[1])


@query("boosted_trees", "ML5,ML7")
def boosted_trees(spark, sf):
    return summary(models.run_experiment("gbt", "gbt", rows(spark, sf), INPUTS, SMALL["gbt"])[1])


@query("random_forest", "ML6,ML7")
def random_forest(spark, sf):
    return summary(models.run_experiment("forest", "random_forest", rows(spark, sf), INPUTS, SMALL["random_forest"], fraction=0.3, min_rows=2000)[1])


@query("experiment_metrics", "ML7,M13,M12")
def experiment_metrics(spark, sf):
    _, preds = models.run_experiment("card", "scorecard", rows(spark, sf), INPUTS, SMALL["scorecard"])
    return rounded(models.experiment_metrics(preds), 4, "auc", "pr_auc", "ks", "gap", "score_psi")


@query("model_race", "ML9,U3")
def model_race(spark, sf):
    preds = models.model_race(["scorecard", "random_forest"], rows(spark, sf), INPUTS, params=SMALL)
    scores = metrics.auc(preds.where("split = 'oot_dev'"), ["exp_id"]).select(F.lit("t").alias("task_id"), F.col("exp_id").alias("model"), F.col("auc").alias("score"))
    return judge.race_tie(scores, 0.01, ["random_forest", "scorecard"])


@query("parameter_search", "ML8")
def parameter_search(spark, sf):
    s = rows(spark, sf)
    best, done = models.param_search("scorecard", s, INPUTS, 3, seed=1)
    return spark.createDataFrame([(i, float(p["C"]), int(p["n_bins"]), v and round(v, 4), p == best) for i, (p, v) in enumerate(done)], "trial int, c double, n_bins int, auc double, best boolean")


@query("halving_search", "ML8")
def halving_search(spark, sf):
    """Four forests on a ninth of the rows, two on a third, the best on all; one encoder."""
    s = rows(spark, sf)
    space = {"n_trees": {"low": 2, "high": 8, "type": "int"}, "max_depth": {"low": 2, "high": 5, "type": "int"}}
    best, done = models.param_search("random_forest", s, INPUTS, 4, seed=1, space=space, rungs=3, min_rows=200)
    return spark.createDataFrame([(i, int(p["n_trees"]), int(p["max_depth"]), v and round(v, 4), p == best) for i, (p, v) in enumerate(done)], "trial int, n_trees int, max_depth int, auc double, best boolean")


_REFERENCES: dict[tuple[str, str], str] = {}


def reference(spark, sf, s):
    """The task's reference model, fitted once per application and read from then on."""
    key = (spark.sparkContext.applicationId, sf)
    folder = _REFERENCES.setdefault(key, scratch_folder(spark, "reference"))
    return stored.reference_model(s, INPUTS, folder, SMALL["gbt"])


@query("reference_gap", "ML10,ML14")
def reference_gap(spark, sf):
    s = rows(spark, sf)
    return rounded(stored.reference_gap(reference(spark, sf, s), s), 4, "valid", "oot_dev", "gap", "auc_se", "mde")


@query("reference_holdout", "ML10,ML14,ML15,E5")
def reference_holdout(spark, sf):
    """A scorecard on the holdout, its drop judged by the stored reference model's own."""
    s = rows(spark, sf)
    oot, final = s.where("split = 'oot_dev'"), s.where("split = 'holdout'")
    drop = stored.reference_drop(reference(spark, sf, s), oot, final)
    fitted, preds = models.run_experiment("card", "scorecard", s, INPUTS, SMALL["scorecard"])
    score = metrics.auc(preds.where("split = 'oot_dev'"), ["exp_id"]).first()["auc"]
    out = models.holdout_result(fitted, final, score, drop).withColumn("reference_drop", F.lit(drop))
    return rounded(out.select("auc", "oot_dev", "drop", "reference_drop", "overfit_to_oot"), 4, "auc", "oot_dev", "drop", "reference_drop")


@query("against_reference", "ML14,J5")
def against_reference(spark, sf):
    """Two candidates next to the reference model, on the same rows."""
    s = rows(spark, sf)
    preds = models.model_race(["scorecard", "random_forest"], s, INPUTS, params=SMALL)
    out = stored.against_reference(reference(spark, sf, s), s, preds, ["scorecard", "random_forest"], n=100)
    return rounded(out, 4, "delta", "ci_low", "ci_high")


@query("experiment_record", "ML7,E1")
def experiment_record(spark, sf):
    """What the judgement reads about an experiment: trees that stop at their own limit have converged."""
    s = rows(spark, sf)
    fitted, preds = models.run_experiment("gbt", "gbt", s, INPUTS, SMALL["gbt"])
    record = judge.diagnose(stored.experiment_record("gbt", fitted, preds))
    out = record.select("exp_id", "model", "n_features", "n_rows", "best_iter", "max_iter", "valid_auc", "oot_dev_auc", "gap", "score_psi", F.concat_ws(",", "codes").alias("codes"))
    return rounded(out, 4, "valid_auc", "oot_dev_auc", "gap", "score_psi")


@query("contributions", "ML11")
def contributions(spark, sf):
    s = rows(spark, sf)
    fitted, _ = models.run_experiment("forest", "random_forest", s, INPUTS, SMALL["random_forest"])
    parts = cut_lineage(models.contributions(fitted, s.where("split = 'oot_dev'")))
    return rounded(models.explain(parts, len(INPUTS.names)), 4, "share", "corr")


@query("contributions_add_up", "ML11", f"WITH {b.CTE_SPLITS}, m AS (SELECT unnest(['gbt', 'random_forest']) AS model) SELECT _row_id, model, CAST(3 AS BIGINT) AS n_features, CAST(0 AS DOUBLE) AS gap FROM splits, m WHERE split = 'oot_dev'")
def contributions_add_up(spark, sf):
    """Base and contributions next to the margin of every row, for both kinds of trees."""
    s = b.splits(spark, sf).select(ID, "_label", "_obs_time", SPLIT, "total", "half", "cat")
    inputs, out = Inputs(numeric=("total", "half"), categorical=("cat",)), None
    for name in ("gbt", "random_forest"):
        fitted, _ = models.run_experiment(name, name, s, inputs, SMALL[name])
        parts = explain.tree_contributions(fitted, s.where("split = 'oot_dev'"))
        per = parts.groupBy(ID).agg(F.count("*").alias("n_features"), F.round(F.abs(F.max("base") + F.sum("contribution") - F.max("margin")), 6).alias("gap"))
        per = per.select(ID, F.lit(name).alias("model"), "n_features", "gap")
        out = per if out is None else out.unionByName(per)
    return out


PRIORS = {"signal": 1, "total": 0, "qty_sum": -1, "half": 1}


@query("monotone_guard", "ML12", f"""WITH {b.CTE_SPLITS}, train AS (SELECT *, _label AS y FROM splits WHERE split = 'train'), {long_cte('train', WOE_FEATURES, extra='y')},
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / CAST(2 AS DOUBLE) AS rv, y FROM long WHERE v IS NOT NULL),
rho AS (SELECT feature, corr(rv, y) AS rho FROM k GROUP BY 1)
SELECT feature, CASE feature WHEN 'n_lines' THEN 'no_prior' WHEN 'total' THEN 'zero_prior' ELSE CASE WHEN abs(rho) >= 0.01 AND (rho > 0) <> (CASE feature WHEN 'qty_sum' THEN -1 ELSE 1 END > 0) THEN 'disagree' ELSE 'constrained' END END AS decision, {r('rho')} AS rho FROM rho
UNION ALL SELECT 'cat', 'categorical', NULL""")
def monotone_guard(spark, sf):
    train = rows(spark, sf).where("split = 'train'")
    return rounded(models.monotone_guard(train, WOE_FEATURES, PRIORS, ["cat"]), 6, "rho")


@query("monotone_bins", "ML13")
def monotone_bins(spark, sf):
    fitted = cut_lineage(models.woe_table(rows(spark, sf).where("split = 'train'"), INPUTS, 10))
    return rounded(models.monotone_bins(fitted, "signal"), 6, "rate", "monotone_rate")


@query("holdout_masked", "ML15,ML10")
def holdout_masked(spark, sf):
    s = rows(spark, sf)
    fitted, preds = models.run_experiment("card", "scorecard", s, INPUTS, SMALL["scorecard"])
    oot = metrics.auc(preds.where("split = 'oot_dev'"), ["exp_id"]).first()["auc"]
    out = models.holdout_result(fitted, s.where("split = 'holdout'"), oot, mask=["signal"])
    return rounded(out, 4, "auc", "pr_auc", "ks", "lift_top10", "recall_top10", "brier", "oot_dev", "drop", "auc_masked")


LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("aggregate_gain", "ML16,J4")
def aggregate_gain(spark, sf):
    """The order total alone against the total, a planted signal and all line aggregates."""
    s = rows(spark, sf)
    deep = factory.deep_aggregate(table(spark, sf, "lineitem"), "l_orderkey", "line", fields=LINE_NUMBERS)
    wide = cut_lineage(factory.attach(s, deep), (SPLIT,))
    base = Inputs(numeric=("total",))
    extra = Inputs(numeric=("total", "signal", *[c for c in deep.columns if c != ID]))
    return rounded(models.agg_gain(wide, base, extra, n=50, params=SMALL["gbt"]), 4, "delta", "ci_low", "ci_high", "auc_se", "mde")


@query("user_code", "U1,P14", f"WITH {b.CTE_MAIN} SELECT _row_id, {r('ln(1 + total)')} AS log_total, CAST(coalesce(n_lines, 0) * 2 AS DOUBLE) AS twice FROM main")
def user_code(spark, sf):
    import numpy as np

    def compute(batch):
        return batch.assign(log_total=np.log1p(batch["total"]), twice=batch["n_lines"].fillna(0.0) * 2)[[ID, "log_total", "twice"]]

    df = b.main(spark, sf).select(ID, "total", "n_lines")
    return rounded(models.apply_user_code(df, compute, f"{ID} long, log_total double, twice double"), 6, "log_total")


CODED = ["log_total", "twice", "half_up", "flat"]


@query("user_code_registered", "U1,P14,FA14", f"""WITH {b.CTE_SPLITS}, s2 AS (SELECT *, _label AS y, ln(1 + total) AS log_total, 2 * n_lines AS twice, half + 1 AS half_up, CAST(0 AS DOUBLE) AS flat FROM splits),
train AS (SELECT * FROM s2 WHERE split = 'train'), {long_cte('train', CODED, extra='y')}, {BINS}, {IV}, {AUCS},
sides AS (SELECT *, split = 'train' AS ref FROM s2 WHERE split IN ('train', 'oot_dev')), {long_cte('sides', CODED, 'long2', 'ref')}, {psi_cte('long2', 'feature', 'feature', 10)}
SELECT feature AS "column", CASE WHEN iv < 0.02 THEN 'low_iv' WHEN auc > 0.75 THEN 'leak_suspect' WHEN psi > 0.25 THEN 'psi' ELSE 'kept' END AS outcome, 'half,n_lines,total' AS inputs,
  (SELECT count(*) FROM splits WHERE split <> 'holdout') AS n_rows FROM iv_ JOIN auc_ USING (feature) JOIN psi_ USING (feature)""")
def user_code_registered(spark, sf):
    """Code on the open splits, its columns through the funnel, and what became of them."""
    import numpy as np

    def compute(batch):
        made = batch.assign(log_total=np.log1p(batch["total"]), twice=batch["n_lines"] * 2, half_up=batch["half"] + 1, flat=0.0)
        return made[[ID, *CODED]]

    store = registry.FeatureStore(spark, scratch_folder(spark, "store"))
    done = user_code_sets.register_user_code(store, b.splits(spark, sf), "log1p, doubled, shifted, flat", compute, f"{ID} long, log_total double, twice double, half_up double, flat double", ["half", "n_lines", "total"])
    return done.select("column", "outcome", F.concat_ws(",", "inputs").alias("inputs"), "n_rows")
