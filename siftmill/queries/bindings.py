"""Modelling tables derived from the given tables, in Spark and as SQL text.

``main``     one row per order with features of its lines; label F = 1, O = 0, P = not finished
``planted``  labelled rows with columns that carry a known amount of signal
``splits``   ``planted`` with its time split and random validation part
``preds``    keyed predictions of three experiments
``runlog``   the events table read as an append-only run log
``exps``     experiments of that log, each with its parent
``runs_new`` / ``runs_old``  results of two versions per dataset and seed
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, OBS, SPLIT, SPLIT_TIME
from siftmill.operators.label import LabelRule, drop_unlabelled, label_column
from siftmill.operators.splits import build_splits
from siftmill.queries.base import hash_mod, sql_hash_mod, table
from siftmill.session import scratch_root, write_parts
from siftmill.sources.tables import path_exists

WINDOWS = {"train_valid": ("1995-01", "1998-12"), "oot_dev": ("1999-01", "1999-12"), "holdout": ("2000-01", "2001-08")}
STATUS = LabelRule("o_orderstatus", ("F",), ("O",), ("P",))
SEED, VALID = 42, 0.2
BASE = ["total", "n_lines", "qty_sum", "price_max", "disc_min"]
NUMERIC = [*BASE, "signal", "signal_dup", "leaky", "drift", "sparse", "half"]
CATEGORICAL = ["cat"]


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias(ID)).agg(
        F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty_sum"),
        F.max("l_extendedprice").alias("price_max"), F.min("l_discount").alias("disc_min"),
    )


def main(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(ID), label_column(STATUS).alias(LABEL), F.col("o_orderdate").alias(OBS), F.col("o_orderdate").alias(SPLIT_TIME),
        F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
    )
    return o.join(line_features(spark, sf), ID, "left")


def planted(spark: SparkSession, sf: str) -> DataFrame:
    m = drop_unlabelled(main(spark, sf)).withColumns({"h": hash_mod("p", ID, 100), "h2": hash_mod("q", ID, 100)})
    y, h = F.col(LABEL), F.col("h")
    m = m.withColumn("signal", (h + 25 * y).cast("double"))
    return m.withColumns({
        "signal_dup": 2 * F.col("signal") + 1,
        "leaky": F.when(h % 10 == 0, 1 - y).otherwise(y).cast("double"),
        "drift": F.col("signal") + F.when(F.year(OBS) >= 1999, 50.0).otherwise(0.0),
        "sparse": F.when(h % 50 == 0, F.col("total")),
        "half": F.when(~((y == 1) & (F.col("h2") < 60)), F.col("h2").cast("double")),
        "cat": F.when((y == 1) & (F.col("h2") < 30), "1-URGENT").when(F.col("h2") >= 95, None).otherwise(F.col("priority")),
    })


_WRITTEN: dict[tuple[str, str], str] = {}


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split table, written once per application and read from then on, as a task would."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN or not path_exists(spark, f"{_WRITTEN[key]}/_SUCCESS"):
        path = f"{scratch_root(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
        write_parts(build_splits(planted(spark, sf), WINDOWS, VALID, SEED), (SPLIT,), path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


SCORES = {"price": "total / 600000.0", "signal": "signal / 125.0", "mix": "(signal + h2) / 225.0"}


def preds(spark: SparkSession, sf: str) -> DataFrame:
    scored = splits(spark, sf).select(ID, SPLIT, OBS, F.col(LABEL).alias("y"), *[F.expr(e).alias(k) for k, e in SCORES.items()])
    return scored.unpivot([ID, SPLIT, OBS, "y"], list(SCORES), "exp_id", "p")


LABEL_SQL = "CASE WHEN o_orderstatus IN ('F') THEN 1 WHEN o_orderstatus IN ('O') THEN 0 END"
CTE_MAIN = f"""line_features AS (
  SELECT l_orderkey AS _row_id, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty_sum,
         max(l_extendedprice) AS price_max, min(l_discount) AS disc_min
  FROM lineitem GROUP BY l_orderkey),
main AS (
  SELECT o_orderkey AS _row_id, {LABEL_SQL} AS _label, o_orderdate AS _obs_time, o_orderdate AS _split_time,
         o_custkey AS cust, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority,
         n_lines, qty_sum, price_max, disc_min
  FROM orders LEFT JOIN line_features ON o_orderkey = line_features._row_id)"""
CTE_PLANTED = CTE_MAIN + f""",
hashed AS (
  SELECT *, {sql_hash_mod('p', '_row_id', 100)} AS h, {sql_hash_mod('q', '_row_id', 100)} AS h2 FROM main WHERE _label IS NOT NULL),
planted AS (
  SELECT *, CAST(h + 25 * _label AS DOUBLE) AS signal, CAST(2 * (h + 25 * _label) + 1 AS DOUBLE) AS signal_dup,
         CAST(CASE WHEN h % 10 = 0 THEN 1 - _label ELSE _label END AS DOUBLE) AS leaky,
         CAST(h + 25 * _label + CASE WHEN year(_obs_time) >= 1999 THEN 50 ELSE 0 END AS DOUBLE) AS drift,
         CASE WHEN h % 50 = 0 THEN total END AS sparse,
         CASE WHEN NOT (_label = 1 AND h2 < 60) THEN CAST(h2 AS DOUBLE) END AS half,
         CASE WHEN _label = 1 AND h2 < 30 THEN '1-URGENT' WHEN h2 >= 95 THEN NULL ELSE priority END AS cat
  FROM hashed)"""
CTE_SPLITS = CTE_PLANTED + f""",
timed AS (
  SELECT *, CASE WHEN _split_time >= DATE '1995-01-01' AND _split_time < DATE '1999-01-01' THEN 'train'
                 WHEN _split_time >= DATE '1999-01-01' AND _split_time < DATE '2000-01-01' THEN 'oot_dev'
                 WHEN _split_time >= DATE '2000-01-01' AND _split_time < DATE '2001-09-01' THEN 'holdout' END AS s0
  FROM planted),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s0 ORDER BY md5('{SEED}|' || CAST(_row_id AS VARCHAR)), _row_id) AS rk,
         count(*) OVER (PARTITION BY s0) AS sz
  FROM timed WHERE s0 IS NOT NULL),
splits AS (
  SELECT *, CASE WHEN s0 = 'train' AND rk <= floor(sz * CAST({VALID} AS DOUBLE)) THEN 'valid' ELSE s0 END AS split FROM ranked)"""
CTE_PREDS = CTE_SPLITS + """,
preds AS (
  SELECT _row_id, split, _obs_time, _label AS y, 'price' AS exp_id, total / 600000.0 AS p FROM splits
  UNION ALL SELECT _row_id, split, _obs_time, _label, 'signal', signal / CAST(125.0 AS DOUBLE) FROM splits
  UNION ALL SELECT _row_id, split, _obs_time, _label, 'mix', (signal + h2) / CAST(225.0 AS DOUBLE) FROM splits)"""


# ---- run log and experiments ----------------------------------------------------------------

TYPES = {"signup": "state_transition", "view": "llm_call", "click": "decision_rejected", "purchase": "recorded", "error": "evaluated"}
VERDICTS = ("ACCEPT", "REJECT", "INCONCLUSIVE", "PROMISING")
ERRORS = ("configuration already used", "template is empty", "over budget", "JSON expected", "something else")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def log_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Plain fields of the run log before they are packed into JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"), (F.col("event_id") * 1.5).alias("ts"),
        F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in TYPES.items()]).alias("type"), "event_type", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("eid"), k.alias("k"),
    )
    return e.withColumn("exp_id", F.when(F.col("type").isin("recorded", "evaluated"), F.col("eid")))


def runlog(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, task_id, ts, type, exp_id, payload)``."""
    f = log_fields(spark, sf)
    of, k = (lambda t: F.col("type") == t), F.col("k")
    usage = F.struct(k.alias("input_cache_hit"), (2 * k).alias("input_cache_miss"), (k + 1).alias("output"), F.lit(0).alias("reasoning"))
    body = F.struct(
        F.when(of("state_transition"), F.when(k >= 97, "FINAL_GATE").when(k % 2 == 0, "DECIDE").otherwise("EVALUATE")).alias("to"),
        F.when(of("state_transition"), k / 4.0).alias("sec"),
        F.when(of("llm_call"), k * 10).alias("tokens"), F.when(of("llm_call") & (k % 4 != 0), usage).alias("usage"), F.when(of("llm_call") & (k == 13), "timeout").alias("error"),
        F.when(of("decision_rejected"), F.array(_pick(ERRORS, k % 5))).alias("errors"),
        F.when(of("recorded") | of("evaluated"), _pick(VERDICTS, k % 4)).alias("verdict"), F.when(of("recorded"), k % 3 == 0).alias("worth"),
        F.when(of("evaluated"), F.struct(((k - 50) / 1000.0).alias("delta"), (k > 60).alias("significant"))).alias("compare"),
    )
    return f.select("id", "task_id", "ts", "type", "exp_id", F.to_json(body).alias("payload"))


def _case(column: str, values, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CTE_LOG = f"""logf AS (
  SELECT event_id AS id, 't' || CAST(user_id AS VARCHAR) AS task_id, event_id * CAST(1.5 AS DOUBLE) AS ts,
         CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items())} END AS type,
         'e' || CAST(event_id AS VARCHAR) AS eid, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
log AS (
  SELECT *, CASE WHEN type IN ('recorded', 'evaluated') THEN eid END AS exp_id,
         CASE WHEN type = 'state_transition' THEN CASE WHEN k >= 97 THEN 'FINAL_GATE' WHEN k % 2 = 0 THEN 'DECIDE' ELSE 'EVALUATE' END END AS to_state,
         CASE WHEN type = 'state_transition' THEN k / CAST(4 AS DOUBLE) END AS sec,
         CASE WHEN type = 'llm_call' THEN k * 10 END AS tokens,
         type = 'llm_call' AND k % 4 <> 0 AS itemised,
         CASE WHEN type IN ('recorded', 'evaluated') THEN {_case('', VERDICTS, '(k % 4)')} END AS verdict,
         CASE WHEN type = 'recorded' THEN k % 3 = 0 END AS worth,
         CASE WHEN type = 'evaluated' THEN CAST(k - 50 AS DOUBLE) / 1000 END AS delta,
         CASE WHEN type = 'evaluated' THEN k > 60 END AS significant
  FROM logf)"""

ACTIONS = ("RACE", "EXPAND_FEATURES", "PROMOTE_FIDELITY", "TUNE", "BACKTRACK")
FIDELITY = ("low", "full", "none")


def exps(spark: SparkSession, sf: str) -> DataFrame:
    """Experiments of the log; the parent is the experiment at half the position in the task."""
    k = F.col("k")
    base = log_fields(spark, sf).where(F.col("exp_id").isNotNull()).select(
        "exp_id", "task_id", F.col("id").alias("seq"), "k", _pick(ACTIONS, k % 5).alias("action_type"), _pick(FIDELITY, F.floor(k / 5) % 3).alias("fidelity"),
        F.concat(F.lit("c"), (k % 20).cast("string")).alias("config_hash"), _pick(VERDICTS, k % 4).alias("verdict"), (k == 77).alias("invalidated"),
        (0.5 + k / 400.0).alias("oot_dev_auc"), (k % 3).alias("n_kept"), (k % 2 == 0).alias("worth"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("params"),
        F.when(k % 11 == 0, F.array(F.lit("EXPAND_FAILED"))).otherwise(F.array().cast("array<string>")).alias("diagnosis_codes"), ((k - 50) / 1000.0).alias("delta"),
    )
    placed = base.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy("seq")) - 1)
    parent = placed.select("task_id", F.col("pos").alias("ppos"), F.col("exp_id").alias("parent_exp_id"))
    half = F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / 2))
    out = placed.withColumn("ppos", half).join(parent, ["task_id", "ppos"], "left").drop("ppos")
    return out.withColumn("target_exp_id", F.when(F.col("action_type") == "PROMOTE_FIDELITY", F.col("parent_exp_id")))


CTE_EXPS = CTE_LOG + f""",
exps0 AS (
  SELECT exp_id, task_id, id AS seq, k, {_case('', ACTIONS, '(k % 5)')} AS action_type, {_case('', FIDELITY, '((k // 5) % 3)')} AS fidelity,
         'c' || CAST(k % 20 AS VARCHAR) AS config_hash, {_case('', VERDICTS, '(k % 4)')} AS verdict, k = 77 AS invalidated,
         CAST(0.5 AS DOUBLE) + CAST(k AS DOUBLE) / 400 AS oot_dev_auc, k % 3 AS n_kept, k % 2 = 0 AS worth, 'p' || CAST(k % 3 AS VARCHAR) AS params,
         k % 11 = 0 AS failed_code, CAST(k - 50 AS DOUBLE) / 1000 AS delta,
         row_number() OVER (PARTITION BY task_id ORDER BY id) - 1 AS pos
  FROM log WHERE exp_id IS NOT NULL),
exps AS (
  SELECT a.*, b.exp_id AS parent_exp_id, CASE WHEN a.action_type = 'PROMOTE_FIDELITY' THEN b.exp_id END AS target_exp_id
  FROM exps0 a LEFT JOIN exps0 b ON a.task_id = b.task_id AND a.pos > 0 AND b.pos = (a.pos - 1) // 2)"""


# ---- version results ------------------------------------------------------------------------

def runs(spark: SparkSession, sf: str, version: int) -> DataFrame:
    """Results per dataset (order priority) and seed from the orders of one parity."""
    o = table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == version)
    agg = o.groupBy(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 3).cast("int").alias("seed")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("o"),
        F.count_if(F.col("o_totalprice") > 400000).alias("big"), F.count("*").alias("cnt"),
    )
    failed = (F.col("seed") == 2) & (F.col("dataset") == "5-LOW") & F.lit(version == 1)
    return agg.select(
        "dataset", "seed", F.when(failed, "failed").otherwise("ok").alias("status"), F.when(~failed, F.round(0.5 + F.col("f"), 4)).alias("holdout"),
        F.round(0.5 + F.col("o"), 4).alias("oot_dev"), F.col("cnt").cast("double").alias("wall_sec"), (F.col("big") / 100.0).alias("cost_usd"),
        F.round(F.col("big") / F.col("cnt"), 4).alias("wasted_rate"), (F.col("big") % 4).cast("double").alias("rejected_decisions"),
        F.round(F.col("f"), 4).alias("upgrade_hit_rate"), (F.col("cnt") % 2).cast("double").alias("fe_in_final"),
    )


def baselines(spark: SparkSession, sf: str, version: int) -> DataFrame:
    o = table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == version)
    agg = o.groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("p"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f"))
    names = F.explode(F.array(F.lit("b0"), F.lit("b1")))
    return agg.select("dataset", names.alias("name"), F.round(0.5 + F.col("f"), 4).alias("oot_dev_auc"), F.round(0.5 + F.col("p"), 4).alias("holdout_auc"))


def _runs_sql(version: int) -> str:
    failed = f"(seed = 2 AND dataset = '5-LOW' AND {'TRUE' if version == 1 else 'FALSE'})"
    return f"""(
  SELECT dataset, seed, CASE WHEN {failed} THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN NOT {failed} THEN round(CAST(0.5 AS DOUBLE) + f, 4) END AS holdout, round(CAST(0.5 AS DOUBLE) + o, 4) AS oot_dev, CAST(cnt AS DOUBLE) AS wall_sec,
         big / CAST(100 AS DOUBLE) AS cost_usd, round(CAST(big AS DOUBLE) / cnt, 4) AS wasted_rate, CAST(big % 4 AS DOUBLE) AS rejected_decisions,
         round(f, 4) AS upgrade_hit_rate, CAST(cnt % 2 AS DOUBLE) AS fe_in_final
  FROM (SELECT o_orderpriority AS dataset, CAST(o_custkey % 3 AS INTEGER) AS seed, avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS f,
               avg(CASE WHEN o_orderstatus = 'O' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS o, count(*) FILTER (WHERE o_totalprice > 400000) AS big, count(*) AS cnt
        FROM orders WHERE o_orderkey % 2 = {version} GROUP BY 1, 2))"""


def _base_sql(version: int) -> str:
    return f"""(
  SELECT dataset, name, round(CAST(0.5 AS DOUBLE) + f, 4) AS oot_dev_auc, round(CAST(0.5 AS DOUBLE) + p, 4) AS holdout_auc
  FROM (SELECT o_orderpriority AS dataset, avg(CASE WHEN o_orderstatus = 'P' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p,
               avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS f
        FROM orders WHERE o_orderkey % 2 = {version} GROUP BY 1), (VALUES ('b0'), ('b1')) AS names(name))"""


CTE_RUNS = f"runs_new AS {_runs_sql(1)}, runs_old AS {_runs_sql(0)}, base_new AS {_base_sql(1)}, base_old AS {_base_sql(0)}"
