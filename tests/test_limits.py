"""Results must not change with width, length, order or missing values."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftmill import session
from siftmill.columns import ID, LABEL
from siftmill.operators import investigate, judge, models, quality, screen
from siftmill.plans import ordered, sampling
from siftmill.queries import runs


def test_correlation_of_many_features_with_nulls(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 25)) + 1e6
    x[:, 1] = x[:, 0] + rng.normal(size=400)
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(25)])
    pdf["flat"] = 3.0
    want = pdf.corr()
    got = {(r["a"], r["b"]): r["corr"] for r in screen.correlation_table(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    assert len(got) == 26 * 25 // 2
    for (a, b), c in got.items():
        assert (c is None and "flat" in (a, b)) or np.isclose(c, want.loc[a, b], atol=1e-9)


def test_tiles_do_not_matter(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 60))
    x[:, 7] = x[:, 51] * 2
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(60)])
    df, want = spark.createDataFrame(pdf).repartition(3), pdf.corr()
    for tile in (1000, 23):
        got = {(r["a"], r["b"]): r["corr"] for r in screen.correlation_table(df, list(pdf.columns), tile=tile).collect()}
        assert len(got) == 60 * 59 // 2 and all(np.isclose(c, want.loc[a, b], atol=1e-9) for (a, b), c in got.items())


def greedy(order, pairs):
    close = {frozenset(p) for p in pairs}
    kept, dropped = [], {}
    for f in order:
        rival = next((k for k in kept if frozenset((k, f)) in close), None)
        if rival is None:
            kept.append(f)
        else:
            dropped[f] = rival
    return kept, dropped


def test_pruning_by_rounds_is_greedy(spark):
    rng = np.random.default_rng(9)
    order = [f"f{i}" for i in rng.permutation(30)]
    for share in (0.0, 0.05, 0.4):
        pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if rng.random() < share]
        pairs += [(b, a) for a, b in pairs[:3]] + [("f1", "f1"), ("f1", "other")]
        assert screen.prune_pairs(order, spark.createDataFrame(pairs, "a string, b string")) == greedy(order, [p for p in pairs if p[0] != p[1]])
    chain = [(a, b) for a, b in zip(order[:8], order[1:8], strict=False)]
    assert screen.prune_pairs(order, spark.createDataFrame(chain, "a string, b string")) == greedy(order, chain)


def test_text_boundaries_of_sorted_rows(spark):
    df = spark.range(40_000).select(F.format_string("%08d", "id").alias("k"))
    bounds = ordered.plan_buckets(df, "k", 16)
    sizes = [r["count"] for r in ordered.assign_bucket(df, "k", bounds).groupBy(ordered.BUCKET).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16


def test_long_lineage_and_cycles(spark):
    n = 1500
    chain = spark.createDataFrame([(f"e{i}", f"e{i - 1}" if i else None) for i in range(n)], "exp_id string, parent_exp_id string")
    got = judge.lineage(chain, chain.where(f"exp_id = 'e{n - 1}'")).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    assert (got["n"], got["d"]) == (n, n - 1)
    assert judge.roots(chain).where("root = 'e0'").count() == n
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "exp_id string, parent_exp_id string")
    for walk in (judge.roots, lambda e: judge.lineage(e, e)):
        with pytest.raises(ValueError, match="cycle"):
            walk(ring)


def test_dates_in_screening(spark):
    rows = [(i, i % 2, dt.date(2020, 1, 1) + dt.timedelta(days=i % 2 * 40 + i % 7), dt.datetime(2020, 1, 1, i % 24)) for i in range(300)]
    df = spark.createDataFrame(rows, f"{ID} long, {LABEL} int, day date, at timestamp_ntz")
    auc = {r["feature"]: r["auc"] for r in screen.single_feature_auc(df, ["day", "at"]).collect()}
    iv = {r["feature"]: r["iv"] for r in screen.information_value(df, ["day", "at"]).collect()}
    assert auc["day"] == 1.0 and iv["day"] > 1


def test_missing_categories_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, None, None)], f"{ID} long, a string, b string")
    got = {r[ID]: (r["a__freq"], r["b__freq"]) for r in investigate.frequency_encode(df, ["a", "b"]).collect()}
    assert got == {1: (1, 2), 2: (None, 2), 3: (None, None)}


def test_date_candidates_look_at_all_rows(spark):
    rows = [("-",)] * 60 + [(f"{i % 28 + 1:02d}/{i % 12 + 1:02d}",) for i in range(60)] + [(str(dt.date(2020, 1, 1) + dt.timedelta(days=i)),) for i in range(3000)]
    got = quality.date_candidates(spark.createDataFrame(rows, "seen string")).first()
    assert got["candidate"] and 0.95 < got["parse_share"] < 1


def test_parameter_ranges():
    space = {"depth": {"low": 2, "high": 8, "type": "int"}, "rate": {"low": 0.01, "high": 1.0, "log": True}, "kind": {"choices": ["a", "b"]}}
    points = models.search_points(space, 20, 1, warm=[{"depth": 99, "rate": 0.0, "kind": "a", "other": 1}, {"depth": 3}])
    assert points[0] == {"depth": 8, "rate": 0.01, "kind": "a"} and points[1] == {"depth": 3} and len(points) == 20
    assert all(2 <= p["depth"] <= 8 and 0.01 <= p["rate"] <= 1 and p["kind"] in "ab" for p in points[2:])


def test_experiments_add_up_in_their_order(spark, tmp_path):
    """The last bits of a sum of doubles hang on the order of its terms, and rounding shows them."""
    rng = np.random.default_rng(11)
    n = 400 * 32  # a gap may end in a 5 after the sixth digit
    events = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01"), "user_id": np.arange(n) % 400, "event_type": "error", "value": 1.0, "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, n)]})
    spark.createDataFrame(events).repartition(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    wide = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as in a larger log
    kept = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        got = {r["task_id"]: (r["passed"], r["gap"]) for r in runs.no_signal_scenario(spark, str(tmp_path)).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    numbers = events["props"].str.extract(r"(\d+)")[0].astype(int)
    for user, ks in numbers.groupby(events["user_id"]):
        total = 0.0
        for k in ks:
            total += 0.5 + k / 400
        gap = total / len(ks) - 0.1 - 0.5
        assert got[f"t{user}"] == (gap <= 0.02, float(Decimal(repr(gap)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0)


@pytest.mark.parametrize("strata", [1, 3])
def test_cuts_of_few_strata_do_not_gather_the_rows(spark, strata):
    df = spark.range(5000).withColumn("g", F.col("id") % strata)
    rows = sampling.with_cuts(df, "id", 1, [lambda n: F.floor(n / 5)], ["g"])
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where("_h <= _cut0").count() == sum(len(range(g, 5000, strata)) // 5 for g in range(strata))


def test_parts_can_be_read_by_many_tasks(spark, tmp_path):
    df = spark.range(0, 3_000_000, 1, 1).select("id", F.xxhash64("id").alias("v"), F.lit("a").alias("part"))
    session.write_parts(df, ("part",), f"{tmp_path}/t")
    groups = [pq.ParquetFile(f).num_row_groups for f in tmp_path.glob("t/part=a/*.parquet")]
    assert len(groups) == 1 and groups[0] > 2
