"""Versioned streaming table, registered user code, duplicates of very frequent rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, OBS, SPLIT
from siftmill.operators import quality
from siftmill.operators.registry import FeatureStore
from siftmill.operators.user_code import register_user_code, registered, sources_of
from siftmill.streaming import live_totals as live

LOG = "task_id string, type string, payload string"


def totals_of(df):
    return sorted((r["task_id"] or "", r["type"], r["n"], r["tokens"], r["sec"]) for r in df.collect())


def test_versions_follow_the_stream_and_survive_replays(spark, scratch):
    rng = np.random.default_rng(0)
    made = [(None if i % 37 == 0 else f"t{rng.integers(0, 6)}", f"k{rng.integers(0, 3)}", f'{{"tokens": {i}, "sec": {i / 4}}}') for i in range(600)]
    log = spark.createDataFrame(made, LOG)
    log.repartition(6).write.parquet(f"{scratch}/log")
    stream = lambda: live.run_totals(live.read_event_stream(spark, f"{scratch}/log", log.schema, 2))
    live.write_totals(stream(), f"{scratch}/table", f"{scratch}/checkpoint").start().awaitTermination()
    want = totals_of(live.run_totals(log))
    assert totals_of(live.read_totals(spark, f"{scratch}/table")) == want
    done = live.versions(spark, f"{scratch}/table")
    assert len(done) <= live.KEPT_VERSIONS and done[-1] >= 2
    # A batch that comes again changes nothing, and new files go on from the last version.
    live.put_version(live.run_totals(log).withColumn("n", F.lit(-1).cast("long")), done[-1], f"{scratch}/table")
    assert totals_of(live.read_totals(spark, f"{scratch}/table")) == want
    log.limit(50).write.mode("append").parquet(f"{scratch}/log")
    live.write_totals(stream(), f"{scratch}/table", f"{scratch}/checkpoint").start().awaitTermination()
    assert totals_of(live.read_totals(spark, f"{scratch}/table")) == totals_of(live.run_totals(log.unionByName(log.limit(50))))


def test_a_broken_version_does_not_count(spark, scratch):
    row = lambda task, n: spark.createDataFrame([(task, "k", n)], "task_id string, type string, n long")
    live.put_version(row("a", 1), 0, scratch)
    row("a", 99).write.parquet(live.version_path(scratch, 1))
    (p,) = [x for x in [spark._jvm.org.apache.hadoop.fs.Path(f"{live.version_path(scratch, 1)}/_SUCCESS")]]
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    assert live.versions(spark, scratch) == [0]
    live.put_version(row("b", 2), 1, scratch)
    assert {(r["task_id"], r["n"]) for r in live.read_totals(spark, scratch).collect()} == {("a", 1), ("b", 2)}


@pytest.fixture
def splits(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(2000):
        y = int(rng.integers(0, 2))
        rows.append((i, y, ["train", "valid", "oot_dev", "holdout"][i % 4], float(i), float(y * 0.6 + rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, f"{ID} long, {LABEL} int, {SPLIT} string, {OBS} double, a double, b double")


def test_user_code_is_screened_and_recorded(spark, splits, scratch):
    seen, folder = f"{scratch}/in.parquet", f"{scratch}/store"
    splits.write.parquet(seen)
    s, store = spark.read.parquet(seen), FeatureStore(spark, folder)

    def compute(batch):
        assert LABEL not in batch and SPLIT not in batch and "b" not in batch
        return batch.assign(good=batch["a"] * 2, const=1.0)[[ID, "good", "const"]]

    ddl = f"{ID} long, good double, const double"
    rows = register_user_code(store, s, "good and const", compute, ddl, ["a"]).collect()
    fs_id = rows[0]["fs_id"]
    assert {r["column"]: r["outcome"] for r in rows} == {"good": "kept", "const": "low_iv"} and store.kept(fs_id) == ["good"]
    assert all(r["inputs"] == ["a"] and r["n_rows"] == 1500 for r in rows) and {r["reason"] for r in rows} == {None, "low_iv"}
    ((path, columns),) = rows[0]["sources"]
    assert path.endswith("in.parquet") and set(columns) >= {ID, "a"} and "b" not in columns
    assert registered(store, fs_id) and not registered(store, "other")
    assert store.features(fs_id).where(f"{SPLIT} = 'holdout'").isEmpty()
    out = store.attach(s.where(f"{SPLIT} = 'valid'"), [fs_id], "valid")
    assert out.where("abs(good - 2 * a) > 1e-12").isEmpty() and "const" not in out.columns
    # Complete: not run again, whatever the function.
    assert register_user_code(store, s, "good and const", None, ddl, ["a"]).count() == 2
    with pytest.raises(Exception, match="row ids"):
        register_user_code(store, s, "bad", lambda b: b.head(1).assign(z=1.0), f"{ID} long, z double", ["a"])


def test_sources_name_their_columns(spark, splits, scratch):
    splits.write.parquet(f"{scratch}/x")
    df = spark.read.parquet(f"{scratch}/x").select(ID, (F.col("a") + 1).alias("c")).join(spark.range(3).withColumnRenamed("id", ID), ID)
    told = dict(sources_of(df))
    assert [sorted(v) for k, v in told.items() if k.endswith("/x")] == [sorted([ID, "a"])] and len(told) == 2


def test_duplicates_of_a_third_of_the_rows(spark):
    rows = [("hot", 1, None)] * 700 + [(f"k{i % 500}", i % 2, "x") for i in range(1300)] + [(None, 1, "n")] * 5 + [(None, 2, "n")]
    df = spark.createDataFrame(rows, "k string, v int, t string").repartition(8)
    want = {}
    for r in rows:
        want[r] = want.get(r, 0) + 1
    got = quality.duplicate_rows(df).first()
    assert (got["n_duplicates"], got["n_groups"]) == (sum(n - 1 for n in want.values()), sum(n > 1 for n in want.values()))
    of = {}
    for r in set(rows):
        of.setdefault(r[0], set()).add(r)
    assert {r["k"]: r["n_versions"] for r in quality.duplicate_keys(df, "k").collect()} == {k: len(v) for k, v in of.items() if k is not None and len(v) > 1}
    assert quality.duplicate_rows(df.where("false")).first()["n_groups"] == 0
    # No copy of the hot row is shuffled by its key: the plan answers it by a broadcast.
    plan = quality.repeated_rows(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("broadcast") >= 2
