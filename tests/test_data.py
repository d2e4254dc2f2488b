"""Hand-computed fixtures for labels, splits, policy, features, sources."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, SPLIT
from siftmill.functions import dates, text
from siftmill.operators import factory, inject, label, models, policy, splits
from siftmill.operators import quality as ql
from siftmill.operators.factory import Template, compute_features, deep_aggregate, feature_definitions, parse_aggregate
from siftmill.operators.label import LabelRule, SentinelRule
from siftmill.operators.registry import FeatureStore
from siftmill.sources import eventlog
from siftmill.sources import split_store as st
from siftmill.sources import tables as src


@pytest.fixture(scope="module")
def hist(spark):
    rows = [(1, -10, 100.0, 50.0, 1), (1, -50, 100.0, 100.0, 2), (1, -200, 100.0, 50.0, 365243), (1, 5, 100.0, 10.0, 9), (2, -20, 100.0, 100.0, 3), (2, -25, 100.0, 100.0, 4), (3, 3, 100.0, 10.0, 5)]
    return spark.createDataFrame(rows, "cid long, DAYS_X int, AMT_DUE double, AMT_PAY double, SENT long")


TEMPLATE = Template(
    id="h", source="hist", entity="cid", time_field="DAYS_X", windows=(30, 90, "all"),
    aggs=("count", "avg(AMT_PAY < AMT_DUE)   # monotone_prior: 1", "max(SENT)"), derived=("ratio(30/90)", "trend(30 vs all)", "recency: -max(DAYS_X)"), prior=0,
)


def test_windowed_template(spark, hist):
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,)], "cid long")
    out = {r[ID]: r.asDict() for r in compute_features(hist, TEMPLATE, [SentinelRule(365243, ("SENT",))], ids).collect()}
    one = out[1]
    assert (one["h__a0__w30"], one["h__a0__w90"], one["h__a0__wall"]) == (1, 2, 3)
    assert one["h__a1__w90"] == 0.5 and one["h__a2__wall"] == 2 and one["h__a0__ratio_30_90"] == 0.5
    assert one["h__a1__trend_30_all"] == pytest.approx(1 - 2 / 3) and one["h__recency2"] == 10
    for unknown in (3, 9):
        assert all(v is None for k, v in out[unknown].items() if k != ID)


@pytest.mark.parametrize("heavy", [2, 1000])
def test_deep_aggregates_shuffle_rows_not_partial_results(spark, heavy):
    rows = [(None if i % 9 == 0 else i % 40, float(i), None if i % 7 == 0 else float(i % 5)) for i in range(400)] + [(77, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "e long, v double, w double").repartition(6)
    out = deep_aggregate(df, "e", "c", F.col("v") < 390, made={"m": "v * w"}, heavy_rows=heavy)
    want = {}
    for e, v, w in rows:
        if v < 390:
            want.setdefault(e, []).append((v, w, None if w is None else v * w))
    got = {r[ID]: r.asDict() for r in out.collect()}
    assert got.keys() == want.keys()
    for e, own in want.items():
        assert got[e]["count_c"] == len(own)
        for k, c in enumerate("vwm"):
            known = [x[k] for x in own if x[k] is not None]
            assert [got[e][f"{p}_c_{c}"] for p in ("max", "min", "sum")] == ([max(known), min(known), sum(known)] if known else [None] * 3)
            assert got[e][f"mean_c_{c}"] == (pytest.approx(sum(known) / len(known)) if known else None)
    if heavy == 1000:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_row_template_and_priors(spark):
    app = spark.createDataFrame([(1, 10.0, 5.0), (2, 20.0, 0.0)], "cid long, AMT double, INC double")
    t = Template(id="r", source="app", entity="cid", aggs=("try_divide(AMT, INC)", "AMT / NULLIF(INC, 0)   # monotone_prior: 0"), prior=1)
    out = {r[ID]: r for r in compute_features(app, t).collect()}
    assert out[1]["r__a0"] == 2.0 and out[2]["r__a0"] is None and out[2]["r__a1"] is None
    assert [d["prior"] for d in feature_definitions(t)] == [1, 0]


def test_prose_is_not_an_aggregate():
    assert parse_aggregate("share of months with STATUS in ('1')") is None
    assert parse_aggregate("count").expression == "count(*)"
    assert parse_aggregate("count_distinct(a)").expression == "count(DISTINCT a)"


def test_no_history_and_none_in_window(spark):
    rows = spark.createDataFrame([(1, 7, datetime.date(2020, 2, 29)), (2, 8, datetime.date(2020, 3, 1)), (3, 7, datetime.date(2020, 3, 1)), (4, None, None)], f"{ID} long, e long, obs date")
    child = spark.createDataFrame([(7, datetime.date(2020, 1, 1), 5.0), (7, datetime.date(2020, 1, 1), 7.0), (7, datetime.date(2020, 3, 1), 99.0), (None, None, 1.0)], "e long, t date, v double")
    out = {r[ID]: r for r in factory.observed_window_totals(rows, child, "e", "obs", "t", {"v": "v"}, [30, "all"]).collect()}
    assert out[1]["count__w30"] == 0 and out[1]["sum_v__w30"] is None and out[1]["count__wall"] == 2 and out[1]["avg_v__wall"] == 6.0
    assert out[2]["count__wall"] is None and out[3]["count__wall"] == 3 and out[3]["max_v__w30"] == 99.0 and out[4]["count__w30"] is None


@pytest.mark.parametrize("buckets", [1, 9])
def test_windows_at_exact_instants(spark, buckets):
    """Every pair of row and event; one entity holds most events, instants repeat and precede 1970."""
    rng = np.random.default_rng(buckets)
    base = datetime.datetime(1969, 12, 28)
    at = lambda: base + datetime.timedelta(hours=int(rng.integers(0, 200)), microseconds=int(rng.integers(0, 3)))
    child = [(int(rng.choice([1, 1, 1, 2, 3])), at(), None if rng.random() < 0.2 else float(rng.integers(-50, 50))) for _ in range(300)]
    rows = [(i, int(rng.choice([1, 2, 3, 4])), at()) for i in range(60)] + [(60, 1, child[0][1]), (61, 1, child[0][1])]
    windows = {"0_5": 0.5, "2": 2, "all": None}
    events = spark.createDataFrame(child, "e int, t timestamp_ntz, v double")
    got = {r[ID]: r for r in factory.observed_window_totals(spark.createDataFrame(rows, f"{ID} long, e int, obs timestamp_ntz"), events, "e", "obs", "t", {"v": "v"}, [0.5, 2, "all"], buckets).collect()}
    assert len(got) == len(rows)
    for i, e, obs in rows:
        seen = [(t, v) for x, t, v in child if x == e and t <= obs]
        for tag, days in windows.items():
            inside = [v for t, v in seen if days is None or obs - t <= datetime.timedelta(days=days)]
            known = [v for v in inside if v is not None]
            want = (len(inside), sum(known), sum(known) / len(known), min(known), max(known)) if known else (len(inside), None, None, None, None)
            assert tuple(got[i][f"{c}__w{tag}"] for c in ("count", "sum_v", "avg_v", "min_v", "max_v")) == pytest.approx(want if seen else (None,) * 5), (i, tag)


def test_feature_store(spark, hist, scratch):
    store = FeatureStore(spark, scratch)
    store.register("fs_x", compute_features(hist, TEMPLATE), feature_definitions(TEMPLATE), ["h__a0__wall"])
    out = store.attach(spark.createDataFrame([(1,), (9,)], f"{ID} long"), ["fs_x"])
    assert out.columns == [ID, "h__a0__wall"] and {r[ID]: r["h__a0__wall"] for r in out.collect()} == {1: 3, 9: None}


# ---- policy, labels, splits -----------------------------------------------------------------

POLICY = policy.FieldPolicy(
    fields={"income": {"availability": "application"}, "fico": {"availability": "application"}, "zip_code": {"availability": "application"}, "grade": {"availability": "loan_terms"}, "total_pymnt": {"availability": "application"}, "funded_inv": {"availability": "application"}},
    leakage=("total_pymnt", "loan_status"), leakage_prefixes=("hardship_",), compliance=("zip_code",), incumbent=("grade",), unknown=("funded_inv",), patterns=("pymnt", "^last_"), special=("loan_status", "id", "issue_d"),
)
COLUMNS = "id issue_d income fico zip_code grade total_pymnt funded_inv hardship_x new_col last_thing loan_status term".split()


def test_column_policy():
    got = policy.column_policy([c for c in COLUMNS if c != "term"], POLICY)
    assert got.keep == ["income", "fico"]
    assert got.drop["leakage"] == ["hardship_x", "loan_status", "total_pymnt"] and got.drop["incumbent"] == ["grade"]
    assert got.quarantine == ["funded_inv", "last_thing", "new_col"] and got.pattern_hits_quarantined == ["last_thing"]
    assert "grade" in policy.column_policy(COLUMNS, POLICY, use_incumbent=True).keep
    assert "new_col" in policy.column_policy(COLUMNS, POLICY, unregistered="application").keep


def test_availability_takes_the_weakest():
    known = {"a": {"availability": "application"}, "b": {"availability": "post_outcome"}}
    assert policy.derived_availability("a + b", known, "application") == ("post_outcome", True)
    assert policy.derived_availability("a * 2", known) == ("application", False)
    assert policy.derived_availability("1 + 1", known) == ("application", False)


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(0)
    months = pd.period_range("2012-01", "2013-12", freq="M")
    m = months[rng.integers(0, 24, 4000)]
    pdf = pd.DataFrame({"id": np.arange(4000), "issue_d": [p.strftime("%b-%Y") for p in m], "income": rng.normal(size=4000), "loan_status": rng.choice(["Fully Paid", "Charged Off", "Current"], 4000, p=[0.7, 0.2, 0.1])})
    df = spark.createDataFrame(pdf).withColumn("_split_time", dates.parse_time("issue_d", "MMM-yyyy"))
    return pdf.assign(month=[p.strftime("%Y-%m") for p in m]), df


WINDOWS = {"train_valid": ("2012-01", "2012-12"), "oot_dev": ("2013-01", "2013-06"), "holdout": ("2013-07", "2013-12")}
RULE = LabelRule("loan_status", ("Charged Off",), ("Fully Paid",), ("Current",))


def test_label_and_splits(loans):
    pdf, df = loans
    rows = label.drop_unlabelled(label.with_label(label.with_row_id(df, "id"), RULE))
    out = splits.build_splits(rows, WINDOWS, 0.2, 42).toPandas()
    ok = pdf[pdf.loan_status != "Current"].set_index("id")
    assert len(out) == len(ok)
    for name, lo, hi in (("oot_dev", "2013-01", "2013-06"), ("holdout", "2013-07", "2013-12")):
        assert set(out[out.split == name]["id"]) == set(ok[(ok.month >= lo) & (ok.month <= hi)].index)
    n = (ok.month <= "2012-12").sum()
    assert (out.split == "valid").sum() == int(n * 0.2) and (out.split == "train").sum() == n - int(n * 0.2)


def test_maturity_and_windows(loans):
    _, df = loans
    bad = splits.maturity_check(df, "loan_status", ["Current"], "_split_time", 0.05)
    assert bad.where("data_fatal").count() > 20
    assert splits.windows_ordered(WINDOWS) and not splits.windows_ordered({"a": ("2012-01", "2012-06"), "b": ("2012-06", "2012-12")})
    good = splits.window_classes(df, "_split_time", {**WINDOWS, "empty": ("2020-01", "2020-02")}, label.label_column(RULE))
    assert {r["window"]: r["ok"] for r in good.collect()} == {"train_valid": True, "oot_dev": True, "holdout": True, "empty": False}


def test_derived_circle():
    with pytest.raises(ValueError, match="circle"):
        label.dependency_order({"a": "b + 1", "b": "a + 1"})


def test_holdout_is_isolated(spark, loans, scratch):
    _, df = loans
    rows = label.drop_unlabelled(label.with_label(label.with_row_id(df, "id"), RULE))
    store = st.SplitStore(spark, scratch)
    store.write(splits.build_splits(rows, WINDOWS, 0.2, 42))
    with pytest.raises(st.HoldoutAccessError):
        store.read("holdout")
    with pytest.raises(ValueError):
        store.read("other")
    assert {r[SPLIT] for r in store.read_open().select(SPLIT).distinct().collect()} == {"train", "valid", "oot_dev"}
    calls = []

    def score(h):
        calls.append(1)
        return h.agg(F.count("*").alias("n"))

    gate = st.FinalGate(store, "t1")
    first = gate.run_once("e1", score).first()["n"]
    assert st.FinalGate(store, "t1").run_once("e1", score).first()["n"] == first and len(calls) == 1
    with pytest.raises(st.HoldoutUsedError):
        gate.run_once("e2", score)


def test_csv_types_and_nulls(spark, scratch):
    path = f"{scratch}/t.csv"
    with open(path, "w") as f:
        f.write("a,b,c,d,e\n1,1.5,2020-01-02,x,NA\n2,NA,2021-03-04,NULL,7\n,3,2021-03-05,z,8\n")
    df = src.read_table(spark, path, ["NA", "NULL"])
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "date", "d": "string", "e": "bigint"}
    assert [r["d"] for r in df.orderBy("c").collect()] == ["x", None, "z"]
    assert src.read_header(spark, path) == ["a", "b", "c", "d", "e"]
    assert src.column_union([["a", "b"], ["b", "c"]]) == ["a", "b", "c"]


def test_event_log(spark, scratch):
    ev = spark.createDataFrame([(1, "t", 1.0, "a", None, "{}"), (2, "t", 2.0, "b", "e1", "{}"), (3, "u", 3.0, "b", "e2", "{}")], eventlog.EVENT_SCHEMA)
    eventlog.append_events(ev.where("id < 3"), scratch + "/log")
    eventlog.append_events(ev.where("id = 3"), scratch + "/log")
    log = eventlog.read_events(spark, scratch + "/log")
    assert [r["id"] for r in eventlog.query_events(log, type="b").collect()] == [2, 3]
    assert [r["id"] for r in eventlog.query_events(log, task_id="t", exp_id="e1").collect()] == [2]


def test_dialect_translation(spark):
    assert text.spark_expression("strptime(issue_d, '%b-%Y')") == "try_to_timestamp(issue_d, 'MMM-yyyy')"
    e = text.spark_expression("strptime(y::varchar || '-' || m || '-' || d::varchar, '%Y-%B-%d') - to_days(lead)")
    row = spark.createDataFrame([(2016, "July", 5, 3)], "y int, m string, d int, lead int").select(F.expr(e).alias("t")).first()
    assert row["t"] == datetime.datetime(2016, 7, 2)


# ---- planted issues -------------------------------------------------------------------------

def test_inject_detect_score(spark):
    """Closed loop: most planted issues are found, with few false reports."""
    rng = np.random.default_rng(2)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "amount": rng.normal(100, 10, n).round(2), "age": rng.integers(20, 60, n).astype(float), "cat": rng.choice(["RENT", "OWN"], n), "status": rng.integers(0, 2, n), "days": -rng.integers(0, 900, n), "t": pd.to_datetime("2015-01-15") + pd.to_timedelta(rng.integers(0, 1400, n), unit="D")})
    clean = spark.createDataFrame(pdf)
    d = inject.plant_in_turn(
        clean,
        lambda x: inject.plant_sentinel(x, "id", "amount", -1, 0.02, 1),
        lambda x: inject.plant_variants(x, "id", "cat", "RENT", ["rent", " RENT"], 0.05, 2),
        lambda x: inject.plant_after_cutoff(x, "id", "days", 0.01, 3),
        lambda x: inject.plant_post_outcome(inject.plant_missing_months(x, "t", ["2016-05"]), "id", "late", "status", 0.1, 4),
        lambda x: inject.plant_duplicate_keys(x, "id", 0.005, 5),
        lambda x: inject.plant_duplicate_rows(x, "id", 0.01, 6),
    )
    found = []
    found += [("sentinel", r["column"]) for r in ql.sentinel_candidates(d, ["amount", "age", "days"]).collect()]
    found += [("category_variants", c) for c in {r["column"] for r in ql.category_variants(d, ["cat"]).collect()}]
    found += [("after_cutoff", r["field"]) for r in ql.after_cutoff(d, ["days"]).where("n_after > 0").collect()]
    found += [("missing_months", "t")] if [r["month"] for r in ql.missing_months(d, "t").collect()] == ["2016-05"] else []
    found += [("duplicate_rows", None)] if ql.duplicate_rows(d).first()["n_duplicates"] > 0 else []
    found += [("duplicate_key", "id")] if ql.duplicate_keys(d, "id").count() > 0 else []
    from siftmill.operators.screen import single_feature_auc

    found += [("post_outcome", r["feature"]) for r in single_feature_auc(d.withColumn(LABEL, F.col("status")), ["amount", "age", "days", "late"]).where("auc > 0.75").collect()]
    answers = [("sentinel", "amount"), ("category_variants", "cat"), ("after_cutoff", "days"), ("missing_months", "t"), ("post_outcome", "late"), ("duplicate_key", "id"), ("duplicate_rows", None)]
    a = spark.createDataFrame([(k, "m", c, k == "sentinel", False) for k, c in answers], "kind string, table string, column string, must_find boolean, optional boolean")
    f = spark.createDataFrame([(k, "m", c) for k, c in found], "kind string, table string, column string")
    s = ql.score_findings(a, f).first()
    assert s["found_rate"] >= 0.8 and s["must_find_ok"] and s["n_not_problems"] <= 3
    assert d.where("amount = -1").count() >= 60 and inject.recount_duplicate_key(d, "id").first()["n_rows"] >= 19


def test_scoring_rules(spark):
    schema = "kind string, table string, column string, must_find boolean, optional boolean"
    a = spark.createDataFrame([("duplicate_rows", "m", None, False, False), ("sentinel", "m", "x", True, False), ("post_outcome", "m", "y", False, True)], schema)
    f = spark.createDataFrame([("outlier", "m", None), ("sentinel", "m", "z"), ("other", "m", "z"), ("sentinel", "m", "x")], "kind string, table string, column string")
    s = ql.score_findings(a, f).first()
    assert (s["n_answers"], s["n_found"], s["must_find_ok"], s["n_not_problems"]) == (2, 1, True, 2)
    g = spark.createDataFrame([("Duplicated rows", "m", None)], "kind string, table string, column string")
    s = ql.score_findings(a, g).first()
    assert s["n_found"] == 1 and not s["must_find_ok"]


def test_shuffle_and_shrink(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    mixed = inject.shuffle_label(df, "id", "y", 3).toPandas().set_index("id").sort_index()
    assert mixed.y.sum() == 200 and (mixed.y.to_numpy() != (np.arange(1000) % 5 == 0)).sum() > 100
    small = inject.shrink_split(df, "id", "y", 20, 1).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in small} == {1: 20, 0: 80}


def test_user_code_must_keep_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], f"{ID} long, x double")
    good = models.apply_user_code(df, lambda b: b.assign(z=b["x"] * 2), f"{ID} long, z double")
    assert good.where("z != 0").count() == 19
    with pytest.raises(Exception, match="row ids"):
        models.apply_user_code(df, lambda b: b.head(1).assign(z=1.0), f"{ID} long, z double").count()
    with pytest.raises(ValueError):
        models.apply_user_code(df, lambda b: b, f"{ID} long, a int, b int, c int, d int, e int, f int")
