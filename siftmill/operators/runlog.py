"""Analytics over the append-only event log ``(id, task_id, ts, type, exp_id, payload)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.judge import lineage
from siftmill.plans.ordered import history_columns, plan_buckets, running_totals

# The payload fields that the analytics read, by event type.
PAYLOAD = (
    "`from` string, `to` string, sec double, tokens long, latency_s double, error string, "
    "usage struct<input_cache_hit:long,input_cache_miss:long,output:long,reasoning:long>, "
    "decision struct<action:string>, errors array<string>, verdict string, reason string, worth boolean, "
    "compare struct<delta:double,k:int,significant:boolean>, underpowered boolean, metric string, holdout_auc double, oot_dev_auc double"
)
# Codes of experiments that produced nothing, and words that tell why a decision was refused.
FAIL_CODES = ("EXPAND_FAILED", "EXPAND_EMPTY", "BUDGET_EXCEEDED")
REJECT_KINDS = {
    "duplicate": ("already used", "taboo"), "template": ("template",), "budget": ("budget",), "prior": ("policy prior",), "format": ("JSON",),
}


def parse_payload(events: DataFrame) -> DataFrame:
    """Add the parsed payload as struct ``pl``."""
    return events.withColumn("pl", F.from_json("payload", PAYLOAD))


def segment_events(events: DataFrame, buckets: int | None = None) -> DataFrame:
    """Number the rounds of every task: each transition to DECIDE closes a segment.

    Adds ``segment`` (0 = setup), ``finale`` and ``kind``. The closing event belongs to the
    segment it closes. Running counts are cut along the event id, so a very long log is fine.
    """
    pl = events if "pl" in events.columns else parse_payload(events)
    step = (F.col("type") == "state_transition").cast("int")
    to_decide = F.coalesce(step * (F.col("pl.to") == "DECIDE").cast("int"), F.lit(0))
    to_final = F.coalesce(step * (F.col("pl.to") == "FINAL_GATE").cast("int"), F.lit(0))
    marked = pl.withColumns({"_d": to_decide, "_f": to_final})
    run = running_totals(marked, ["task_id"], ["id"], {"_nd": F.col("_d"), "_nf": F.col("_f")}, plan_buckets(events, "id", buckets))
    segment, finale = F.col("_nd") - F.col("_d"), (F.col("_nf") - F.col("_f")) > 0
    kind = F.when(finale, "finale").when(segment == 0, "setup").otherwise("round")
    return run.withColumns({"segment": segment, "finale": finale, "kind": kind}).drop("_d", "_f", "_nd", "_nf")


def round_rows(segments: DataFrame) -> DataFrame:
    """One row per segment: last decision, verdict and delta, calls, rejections, tokens, seconds."""
    of = lambda t: F.col("type") == t
    last = lambda c, t: F.max_by(c, F.when(of(t) & c.isNotNull(), F.col("id")))
    return segments.groupBy("task_id", "segment", "kind").agg(
        last(F.col("pl.decision.action"), "decision").alias("action"), last(F.col("exp_id"), "recorded").alias("exp_id"),
        last(F.col("pl.verdict"), "recorded").alias("verdict"), last(F.col("pl.compare.delta"), "evaluated").alias("delta"),
        F.count_if(of("llm_call")).alias("n_calls"), F.count_if(of("decision_rejected")).alias("n_rejected"),
        F.coalesce(F.sum(F.when(of("llm_call"), F.col("pl.tokens"))), F.lit(0)).alias("tokens"),
        (F.max("ts") - F.min("ts")).alias("seconds"), F.count("*").alias("n_events"),
    )


def summarize(segments: DataFrame) -> DataFrame:
    """Totals per task: rounds, calls, errors, tokens, rejections, verdicts, stop reason, last state."""
    of = lambda t: F.col("type") == t
    verdict = lambda v: F.count_if(of("recorded") & (F.col("pl.verdict") == v)).alias(f"n_{v.lower()}")
    return segments.groupBy("task_id").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "round", F.col("segment"))), F.lit(0)).cast("long").alias("n_rounds"),
        F.count_if(of("llm_call")).alias("n_calls"), F.count_if(of("llm_call") & F.col("pl.error").isNotNull()).alias("n_errors"),
        F.coalesce(F.sum(F.when(of("llm_call"), F.col("pl.tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(of("decision_rejected")).alias("n_rejected"), *[verdict(v) for v in ("ACCEPT", "REJECT", "PROMISING", "INCONCLUSIVE")],
        F.max_by(F.col("pl.reason"), F.when(of("stop"), F.col("id"))).alias("stop_reason"),
        F.max_by(F.col("pl.to"), F.when(of("state_transition"), F.col("id"))).alias("final_state"),
    )


# The token kinds of a usage record; cost counts the first three.
USAGE_KEYS = ("input_cache_hit", "input_cache_miss", "output", "reasoning")
PRICED = USAGE_KEYS[:3]


def usage_totals(events: DataFrame, prices: Mapping[str, float] | None = None) -> DataFrame:
    """Token totals and cost per task; a call without itemised usage counts as uncached input."""
    calls = (events if "pl" in events.columns else parse_payload(events)).where(F.col("type") == "llm_call")
    item = lambda k: F.coalesce(F.col(f"pl.usage.{k}"), F.lit(0))
    bare = F.when(F.col("pl.usage").isNull(), F.coalesce(F.col("pl.tokens"), F.lit(0))).otherwise(0)
    out = calls.groupBy("task_id").agg(
        F.count("*").alias("calls"),
        *[F.sum(item(k) + (bare if k == "input_cache_miss" else F.lit(0))).alias(k) for k in USAGE_KEYS],
    )
    if prices is None:
        return out.withColumn("cost_usd", F.lit(None).cast("double"))
    return out.withColumn("cost_usd", sum((F.col(k) * float(prices[k]) for k in PRICED), F.lit(0.0)) / 1e6)


def usage_cost(usage: DataFrame, price_table: DataFrame, on: str = "provider") -> DataFrame:
    """Cost per row from a price table ``(provider, input_cache_hit, input_cache_miss, output)`` per million."""
    p = price_table.select(on, *[F.col(k).alias(f"_p_{k}") for k in PRICED])
    cost = sum((F.col(k) * F.col(f"_p_{k}") for k in PRICED), F.lit(0.0)) / 1e6
    return usage.join(p, on, "left").withColumn("cost_usd", cost).drop(*[f"_p_{k}" for k in PRICED])


def wall_seconds(events: DataFrame) -> DataFrame:
    """Sum of state durations: unlike last minus first time it leaves out waiting for people."""
    pl = events if "pl" in events.columns else parse_payload(events)
    return pl.where(F.col("type") == "state_transition").groupBy("task_id").agg(F.sum(F.coalesce("pl.sec", F.lit(0.0))).alias("wall_sec"))


def wasted_rounds(exps: DataFrame) -> DataFrame:
    """Experiments that failed or repeat an earlier configuration of the task, and their share.

    All that counts is how many rounds of a configuration there are, how many failed and what its
    first one did, so rows are summed by configuration and never joined back to it.
    """
    used = F.when(F.col("fidelity") != "none", F.col("config_hash"))
    failed = F.coalesce(F.arrays_overlap("diagnosis_codes", F.array(*[F.lit(c) for c in FAIL_CODES])), F.lit(False))
    round_ = F.col("action_type") != "RACE"
    by_seq = exps.groupBy("task_id", F.when(used != "", used).alias("_hash"), "seq").agg(F.count_if(round_).alias("_n"), F.count_if(round_ & failed).alias("_bad"))
    by_hash = by_seq.groupBy("task_id", "_hash").agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad"), F.min_by(F.struct("_n", "_bad"), "seq").alias("_first"))
    again = F.when(F.col("_hash").isNull(), F.col("_bad")).otherwise(F.col("_n") - F.col("_first._n") + F.col("_first._bad"))
    return by_hash.groupBy("task_id").agg(F.sum("_n").alias("n_rounds"), F.sum(again).alias("n_wasted")).withColumn("wasted_rate", F.try_divide(F.col("n_wasted").cast("double"), F.col("n_rounds")))


def reject_kind(text: Column, kinds: Mapping[str, Sequence[str]] = REJECT_KINDS) -> Column:
    """First kind whose words occur in the message."""
    out = None
    for kind, words in kinds.items():
        test = None
        for w in words:
            test = text.contains(w) if test is None else test | text.contains(w)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def rejected_by_kind(events: DataFrame, kinds: Mapping[str, Sequence[str]] = REJECT_KINDS) -> DataFrame:
    pl = events if "pl" in events.columns else parse_payload(events)
    errors = pl.where(F.col("type") == "decision_rejected").select("task_id", F.explode("pl.errors").alias("error"))
    return errors.groupBy("task_id", reject_kind(F.col("error"), kinds).alias("kind")).agg(F.count("*").alias("n"))


def upgrade_rates(exps: DataFrame, recorded: DataFrame) -> DataFrame:
    """How many worthwhile low-fidelity results were promoted, and how often a promotion won.

    ``recorded`` is ``(task_id, exp_id, at, worth)``, one row per recorded experiment. Only
    experiments after the task's first ACCEPT count; a candidate recorded last could never have
    been promoted and is left out.
    """
    accept = exps.where(F.col("verdict") == "ACCEPT").groupBy("task_id").agg(F.min("seq").alias("_accept"))
    last = recorded.groupBy("task_id").agg(F.max("at").alias("_last"))
    done = exps.where(F.col("action_type") == "PROMOTE_FIDELITY").select("task_id", F.col("target_exp_id").alias("exp_id"), F.lit(True).alias("_done")).distinct()
    after = exps.join(accept, "task_id").where(F.col("seq") > F.col("_accept"))
    marked = after.join(recorded.select("task_id", "exp_id", "at", "worth"), ["task_id", "exp_id"], "left").join(last, "task_id", "left").join(done, ["task_id", "exp_id"], "left")
    worthy = (F.col("action_type") != "RACE") & F.coalesce(F.col("worth"), F.lit(False)) & F.coalesce(F.col("at") < F.col("_last"), F.lit(False))
    up = F.col("action_type") == "PROMOTE_FIDELITY"
    out = marked.groupBy("task_id").agg(
        F.count_if(worthy).alias("n_worth"), F.count_if(worthy & F.coalesce(F.col("_done"), F.lit(False))).alias("n_promoted"),
        F.count_if(up).alias("n_upgrades"), F.count_if(up & (F.col("verdict") == "ACCEPT")).alias("n_upgrades_ok"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.withColumns({"upgrade_hit_rate": rate("n_promoted", "n_worth"), "upgrade_success_rate": rate("n_upgrades_ok", "n_upgrades")})


def final_lineage(exps: DataFrame, finals: DataFrame) -> DataFrame:
    """Steps from the race to the final model, root first."""
    chain = lineage(exps, finals)
    size = chain.groupBy("start_id").agg(F.max("depth").alias("_max"))
    named = chain.join(exps.select("exp_id", "action_type"), "exp_id").join(size, "start_id")
    return named.select("start_id", (F.col("_max") - F.col("depth")).alias("step"), "exp_id", "action_type")


def feature_funnel(exps: DataFrame) -> DataFrame:
    """Feature engineering from attempt to acceptance, per task."""
    ex = F.col("action_type") == "EXPAND_FEATURES"
    promoted = exps.where(F.col("action_type") == "PROMOTE_FIDELITY").groupBy("task_id", F.col("target_exp_id").alias("exp_id")).agg(F.max((F.col("verdict") == "ACCEPT").cast("int")).alias("_won"))
    m = exps.join(promoted, ["task_id", "exp_id"], "left")
    kept = ex & (F.col("n_kept") > 0)
    worth = kept & F.col("worth")
    return m.groupBy("task_id").agg(
        F.count_if(ex).alias("attempts"), F.count_if(kept).alias("kept"), F.count_if(worth).alias("promising"),
        F.count_if(worth & F.col("_won").isNotNull()).alias("promoted"), F.count_if(worth & (F.col("_won") == 1)).alias("accepted"),
    )


def recovery(exps: DataFrame, buckets: int | None = None, order: str = "seq") -> DataFrame:
    """Share of failures after which the task did something else next."""
    own = exps.where(F.col("action_type") != "RACE")
    failed = (F.col("verdict") == "REJECT") | F.coalesce(F.arrays_overlap("diagnosis_codes", F.array(*[F.lit(c) for c in FAIL_CODES])), F.lit(False))
    marked = own.withColumns({"_fail": failed.cast("int"), "_move": F.concat_ws("|", "action_type", F.coalesce("params", F.lit("")))})
    make = {"_prev_fail": ("lag", ("_fail", 1)), "_prev_move": ("lag", ("_move", 1))}
    seen = history_columns(marked, ["task_id"], [order], make, 1, plan_buckets(own, order, buckets))
    pair = F.col("_prev_fail") == 1
    return seen.groupBy("task_id").agg(
        F.count_if(pair).alias("n_failures"), F.count_if(pair & (F.col("_move") != F.col("_prev_move"))).alias("n_changed"),
    ).withColumn("recovery", F.try_divide(F.col("n_changed").cast("double"), F.col("n_failures")))


# ---- scenario checks -----------------------------------------------------------------------

def leak_scenario(exps: DataFrame, quarantined: DataFrame, finals: DataFrame, leak_column: str, margin: float = 0.05) -> DataFrame:
    """A planted leak must be quarantined, unused by accepted models and give no better holdout.

    ``quarantined``: ``(task_id, column)``; ``finals``: ``(task_id, holdout, baseline)``.
    """
    uses = exps.where((F.col("verdict") == "ACCEPT") & F.array_contains("features", leak_column)).groupBy("task_id").agg(F.count("*").alias("n_used"))
    caught = quarantined.where(F.col("column") == leak_column).select("task_id", F.lit(True).alias("_caught")).distinct()
    out = finals.join(uses, "task_id", "left").join(caught, "task_id", "left")
    too_good = F.coalesce(F.col("holdout") > F.col("baseline") + margin, F.lit(False))
    reason = F.when(F.coalesce(F.col("n_used"), F.lit(0)) > 0, "leak_used").when(F.col("_caught").isNull(), "not_quarantined").when(too_good, "holdout_too_good")
    return out.select("task_id", reason.isNull().alias("passed"), reason.alias("reason"))


def no_signal_scenario(finals: DataFrame, chance: float = 0.5, tolerance: float = 0.05) -> DataFrame:
    """Without signal the holdout must stay within ``tolerance`` of chance, or there is no model."""
    gap = F.col("holdout") - chance
    return finals.select("task_id", F.coalesce(gap <= tolerance, F.lit(True)).alias("passed"), gap.alias("gap"))


def small_oot_scenario(events: DataFrame) -> DataFrame:
    """A small OOT slice must be flagged as underpowered and accept nothing insignificant."""
    pl = events if "pl" in events.columns else parse_payload(events)
    flagged = F.bool_or((F.col("type") == "oot_power") & F.coalesce(F.col("pl.underpowered"), F.lit(False)))
    bad = F.count_if((F.col("type") == "evaluated") & (F.col("pl.verdict") == "ACCEPT") & F.col("pl.compare").isNotNull() & ~F.coalesce(F.col("pl.compare.significant"), F.lit(False)))
    out = pl.groupBy("task_id").agg(flagged.alias("underpowered"), bad.alias("n_insignificant_accepts"))
    return out.withColumn("passed", F.col("underpowered") & (F.col("n_insignificant_accepts") == 0))

