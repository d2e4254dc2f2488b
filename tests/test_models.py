"""Encoders, exact tree contributions, stored models, search, judgement of tasks."""

import itertools
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, SPLIT
from siftmill.operators import encoding, explain, judge, models, stored
from siftmill.operators.encoding import Inputs


@pytest.fixture(scope="module")
def rows(spark):
    """A number with gaps, a small category, one with a level for every second row, and the splits."""
    rng = np.random.default_rng(0)
    n = 1600
    y = rng.integers(0, 2, n)
    x = np.where(rng.random(n) < 0.1, np.nan, y + rng.normal(0, 1.0, n))
    cat = np.where(rng.random(n) < 0.05, None, rng.choice(["a", "b", "ü", "Z"], n))
    many = np.array([f"m{i // 2}" for i in range(n)], object)
    split = rng.choice(["train", "valid", "oot_dev", "holdout"], n, p=[0.55, 0.15, 0.2, 0.1])
    many[split == "holdout"] = "never seen"
    d = pd.DataFrame({ID: np.arange(n), LABEL: y, SPLIT: split, "x": x, "z": rng.normal(0, 1, n), "cat": cat, "many": many})
    return spark.createDataFrame(d.astype(object).where(d.notna(), None), f"{ID} long, {LABEL} int, {SPLIT} string, x double, z double, cat string, many string")


INPUTS = Inputs(numeric=("x", "z"), categorical=("cat", "many"))


def test_codes_and_rates(rows):
    d = rows.toPandas()
    train = d[d[SPLIT] == "train"]
    enc = models.fit_encoder(rows.where("split = 'train'"), INPUTS, buckets=3)
    assert enc.columns == ["x__filled", "z__filled", "cat__code", "many__rate"]
    got = enc.transform(rows).toPandas().set_index(ID).loc[d[ID]]
    levels = sorted(train["cat"].dropna().unique(), key=lambda v: v.encode())
    assert [int(c) for c in got["cat__code"]] == [levels.index(v) if v in levels else len(levels) for v in d["cat"]]
    assert np.allclose(got["x__filled"], d["x"].astype(float).fillna(train["x"].astype(float).median()))
    folds = {r[ID]: r["f"] for r in rows.select(ID, encoding.fold_of().alias("f")).collect()}
    prior = train[LABEL].mean()
    for i, r in d.iloc[::7].iterrows():
        own = train[train["many"] == r["many"]]
        if r[SPLIT] == "train":
            own = own[own[ID].map(folds) != folds[r[ID]]]
        assert np.isclose(got["many__rate"].iloc[i], (own[LABEL].sum() + encoding.CREDIT * prior) / (len(own) + encoding.CREDIT))
    assert np.allclose(got.loc[(d[SPLIT] == "holdout").to_numpy(), "many__rate"], prior)


def test_no_row_sees_its_own_label(rows):
    """Turning every label around moves no rate of a training row through its own fold."""
    train = rows.where("split = 'train'")
    one = train.limit(1).select(ID).first()[0]
    flipped = train.withColumn(LABEL, F.when(F.col(ID) == one, 1 - F.col(LABEL)).otherwise(F.col(LABEL)))
    rate = lambda t: models.fit_encoder(t, INPUTS).transform(train).where(F.col(ID) == one).first()["many__rate"]
    prior = lambda t: t.agg(F.avg(LABEL)).first()[0]
    # Only the overall rate, which all rows share, has moved; of two rows a level at most one is left.
    assert abs(rate(train) - rate(flipped)) <= abs(prior(train) - prior(flipped)) + 1e-12


@pytest.mark.parametrize("name", ["gbt", "random_forest"])
def test_a_thousand_levels_fit(rows, name):
    params = {"gbt": {"max_iter": 4, "max_depth": 3}, "random_forest": {"n_trees": 4, "max_depth": 4}}[name]
    fitted, preds = models.run_experiment(name, name, rows, INPUTS, params)
    assert preds.where("p is null or p < 0 or p > 1").isEmpty() and preds.count() == rows.count()
    # A level of two rows says next to nothing, so the noise feature must not carry the model.
    parts = explain.tree_contributions(fitted, rows.where("split = 'oot_dev'"))
    size = {r["feature"]: r["s"] for r in parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("s")).collect()}
    assert size["x"] > 3 * size["many"]
    gap = parts.groupBy(ID).agg(F.abs(F.max("base") + F.sum("contribution") - F.max("margin")).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-9
    assert parts.where("feature = 'x' and x is null").count() == rows.where("split = 'oot_dev' and x is null").count()


def expectation(nodes, at, x, known):
    node = nodes[at]
    if node["left"] < 0:
        return node["value"]
    if node["feature"] in known:
        v = x[node["feature"]]
        left = v in node["split"] if node["categories"] >= 0 else v <= node["split"][0]
        return expectation(nodes, node["left"] if left else node["right"], x, known)
    return sum(nodes[c]["n"] / node["n"] * expectation(nodes, c, x, known) for c in (node["left"], node["right"]))


def random_tree(rng, depth):
    nodes = {}

    def grow(n, level):
        at = len(nodes)
        nodes[at] = {}
        if level == depth or n < 4 or rng.random() < 0.1:
            nodes[at] = {"value": float(rng.normal()), "n": n, "left": -1, "right": -1, "feature": -1, "split": [], "categories": -1}
            return at
        f, k = int(rng.integers(0, 4)), int(rng.integers(1, n))
        split = ([0.0, 2.0], 4) if f == 3 else ([float(rng.normal())], -1)
        nodes[at] = {"value": 0.0, "n": n, "feature": f, "split": split[0], "categories": split[1]}
        nodes[at]["left"], nodes[at]["right"] = grow(k, level + 1), grow(n - k, level + 1)
        return at

    grow(200, 0)
    return nodes


def test_shapley_values_by_definition():
    rng = np.random.default_rng(6)
    for depth in (1, 3, 6):
        nodes = random_tree(rng, depth)
        x = np.column_stack([rng.normal(size=12), rng.normal(size=12), rng.normal(size=12), rng.integers(0, 5, 12)])
        leaves = explain.tree_leaves(nodes, 2.0)
        got = explain.shapley(leaves, x)
        assert np.isclose(sum(leaf.expected for leaf in leaves), 2 * expectation(nodes, 0, x[0], ()))
        for row, parts in zip(x, got, strict=True):
            for j in range(4):
                rest = [k for k in range(4) if k != j]
                want = sum(
                    factorial(s) * factorial(3 - s) / factorial(4) * (expectation(nodes, 0, row, {*c, j}) - expectation(nodes, 0, row, set(c)))
                    for s in range(4) for c in itertools.combinations(rest, s)
                )
                assert np.isclose(parts[j], 2 * want)


def test_swapped_and_scorecard_order_text_by_the_alphabet(rows):
    inputs = Inputs(numeric=("x",), categorical=("cat",))
    fitted, _ = models.run_experiment("card", "scorecard", rows, inputs, {"n_bins": 4})
    oot = rows.where("split = 'oot_dev'")
    place = {v: float(i) for i, v in enumerate(sorted(["a", "b", "ü", "Z"], key=lambda v: v.encode()))}
    cats = {r[ID]: r["cat"] for r in oot.collect()}
    for parts in (explain.contributions(fitted, oot), explain.swapped_contributions(fitted, oot)):
        got = parts.where("feature = 'cat'").collect()
        assert len(got) == oot.count() and all(r["x"] == place.get(cats[r[ID]]) for r in got)


def test_explain_uses_rows_with_a_value(spark):
    parts = spark.createDataFrame([(1, "f", 1.0, 0.1), (2, "f", 2.0, 0.2), (3, "f", None, -9.0), (4, "g", 5.0, 0.0)], f"{ID} long, feature string, x double, contribution double")
    out = {r["feature"]: (round(r["share"], 6), r["corr"]) for r in explain.explain(parts, 2).collect()}
    assert out == {"f": (1.0, 1.0), "g": (0.0, 0.0)}


@pytest.mark.parametrize("name", ["gbt", "scorecard"])
def test_stored_models_score_alike(spark, rows, scratch, name):
    fitted, _ = models.run_experiment(name, name, rows, INPUTS, {"max_iter": 3, "n_bins": 4})
    stored.save(fitted, f"{scratch}/m")
    back = stored.load(spark, f"{scratch}/m")
    p = lambda f: {r[ID]: r["p"] for r in f.score(rows).select(ID, "p").collect()}
    assert p(fitted) == pytest.approx(p(back)) and back.inputs == INPUTS
    assert explain.contributions(back, rows.limit(5)).count() == 5 * 4


def test_reference_is_fitted_once(spark, rows, scratch):
    inputs = Inputs(numeric=("x", "z"))
    first = stored.reference_model(rows, inputs, f"{scratch}/ref", {"max_iter": 3})
    again = stored.reference_model(rows.where("x > 0"), inputs, f"{scratch}/ref", {"max_iter": 1})
    assert again.model.getNumTrees == first.model.getNumTrees == again.info["best_iter"]
    gap = stored.reference_gap(again, rows).first()
    oot, final = rows.where("split = 'oot_dev'"), rows.where("split = 'holdout'")
    assert np.isclose(gap["gap"], gap["valid"] - gap["oot_dev"]) and gap["mde"] > 0
    assert np.isclose(stored.reference_drop(again, oot, final), gap["oot_dev"] - models.holdout_result(again, final, 0.0).first()["auc"])
    assert stored.reference_drop(again, oot, final.where(f"{LABEL} = 1")) == 0.0
    _, preds = models.run_experiment("weak", "scorecard", rows, Inputs(numeric=("z",)), {"n_bins": 3})
    row = stored.against_reference(again, rows, preds, ["weak"], n=60).first()
    assert row["delta"] < 0 and row["ci_low"] < row["delta"] < row["ci_high"] and not row["significant"]


def test_record_feeds_the_judgement(rows):
    fitted, preds = models.run_experiment("g", "gbt", rows, Inputs(numeric=("x",)), {"max_iter": 4})
    record = stored.experiment_record("g", fitted, preds)
    r = judge.diagnose(record).first()
    assert (r["n_features"], r["n_rows"], r["max_iter"]) == (1, rows.where("split = 'train'").count(), 4)
    assert "NO_CONVERGE" not in r["codes"]  # three or four of four trees, where 500 would be asked by default
    assert "NO_CONVERGE" in judge.diagnose(record.withColumn("max_iter", F.lit(None).cast("long"))).first()["codes"]


def test_search_survives_undefined_metrics(rows):
    inputs, space = Inputs(numeric=("x",)), {"n_bins": {"low": 3, "high": 9, "type": "int"}}
    one_class = rows.where(f"split != 'valid' or {LABEL} = 1")
    best, done = models.param_search("scorecard", one_class, inputs, 2, space=space)
    assert best == done[0][0] and all(v is None for _, v in done)
    best, done = models.param_search("random_forest", rows, inputs, 6, space={"n_trees": {"low": 1, "high": 4, "type": "int"}}, rungs=2, min_rows=50)
    assert len(done) == 6 and all(0 <= v <= 1 for _, v in done) and best in [p for p, _ in done]


def test_priors_by_precedence(spark):
    table = {"income": -1, "debt": 1, "note": "unclear", "flag": True}
    aliases = {"inc2": "income", "debt": "income", "x": "absent", "n2": "note"}
    defs = spark.createDataFrame([("income", 1), ("gen", 0), ("none", None)], "name string, prior int")
    want = {"inc2": -1, "debt": 1, "income": 1, "gen": 0}
    assert models.merged_priors(table, aliases, defs) == want
    assert models.merged_priors(table, aliases, [r.asDict() for r in defs.collect()]) == want and models.merged_priors({}) == {}


def exps(spark, rows):
    names = ("task_id", "seq", "exp_id", "action_type", "fidelity", "verdict", "target_exp_id", "delta", "invalidated", "codes", "left")
    ddl = "task_id string, seq int, exp_id string, action_type string, fidelity string, verdict string, target_exp_id string, delta double, invalidated boolean, codes array<string>, left int"
    base = ("t", 0, "e", "TUNE", "low", "PROMISING", None, None, False, [], 5)
    return spark.createDataFrame([tuple({**dict(zip(names, base, strict=True)), **r}.values()) for r in rows], ddl)


def test_task_codes(spark):
    gap = {"seq": 1, "exp_id": "p", "action_type": "PROMOTE_FIDELITY", "fidelity": "full", "verdict": "REJECT", "codes": ["OVERFIT_GAP"], "target_exp_id": "x"}
    final = {"seq": 1, "exp_id": "f", "fidelity": "full", "verdict": "ACCEPT"}
    cases = [
        ([{}], ["NO_FINAL_MODEL"]), ([{}, gap], ["OVERFIT_GAP"]), ([{}, {**gap, "left": 1}], ["OVERFIT_GAP", "NO_FINAL_MODEL"]),
        ([{}, final], ["PROMOTE_CANDIDATE"]), ([{"verdict": "INCONCLUSIVE", "delta": 0.01}, final], ["PROMOTE_CANDIDATE"]),
        ([{"verdict": "INCONCLUSIVE", "delta": -0.01}, final], []), ([{"invalidated": True}, {**final, "invalidated": True}], []),
        ([{}, {**gap, "target_exp_id": "e", "codes": []}, {**final, "seq": 2}], []), ([{"verdict": "REJECT", "codes": ["PLATEAU"]}], ["PLATEAU"]),
    ]
    for rows, want in cases:
        assert judge.decision_codes(exps(spark, rows), rounds_left="left").first()["decision_codes"] == want, rows


def test_nearest_task_at_any_distance(spark):
    rng = np.random.default_rng(3)
    dims = ["n_features", "bad_rate", "missing_rate", "time_span_months"]
    made = [(f"t{i:02d}", int(10 ** rng.uniform(2, 6)), *(float(v) for v in (rng.integers(5, 400), rng.random(), rng.random(), rng.integers(1, 200)))) for i in range(60)]
    made += [(f"twin{i}", *made[0][1:]) for i in range(4)] + [("far", 10**9, 9_000.0, 1.0, 1.0, 5_000.0), ("broken", 100, None, 0.1, 0.1, 9.0)]
    ddl = "task_id string, n_samples long, n_features double, bad_rate double, missing_rate double, time_span_months double"
    df = spark.createDataFrame(made, ddl)
    scale = judge.FINGERPRINT_SCALES
    point = {m[0]: np.array([np.log10(m[1]) / scale["log10_n_samples"], *(v / scale[d] for v, d in zip(m[2:], dims, strict=True))]) for m in made if None not in m}
    got = {r["task_id"]: r for r in judge.nearest_tasks(df, df).collect()}
    assert len(got) == len(made) and got["broken"]["distance"] is None and got["broken"]["cold_start"]
    for t, p in point.items():
        d, name = min((round(float(np.linalg.norm(p - q)), 9), o) for o, q in point.items() if o != t)
        assert np.isclose(got[t]["distance"], d) and got[t]["cold_start"] == (d > 2) and got[t]["nearest"] == (name if d <= 2 else None), t
    alone = judge.nearest_tasks(df.where("task_id = 'far'"), df.where("task_id = 'far'")).first()
    assert alone["distance"] is None and alone["cold_start"]
    assert judge.nearest_tasks(df, df.where("false")).count() == len(made)


def test_many_levels_are_not_sent_to_the_driver(spark, rows, monkeypatch):
    """A table of levels that grows with the rows is joined by a sort, with the same rates."""
    train = rows.where("split = 'train'").withColumn("many", F.concat(F.lit("c"), (F.col(ID) % 97).cast("string")))
    inputs = Inputs(numeric=(), categorical=("many",))
    enc = encoding.fit_encoder(train, inputs)
    rates = lambda: sorted(tuple(r) for r in enc.transform(train).select(ID, "many__rate").collect())
    sent = rates()
    monkeypatch.setattr(encoding, "SENT_BYTES", 0, raising=False)
    plan = enc.transform(train)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert rates() == sent
