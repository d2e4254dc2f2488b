"""Deterministic rules over tables of experiments: diagnosis, verdicts, budgets, lineage."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators.metrics import METRICS
from siftmill.plans.ordered import earlier_max, history_columns, plan_buckets, row_positions, running_totals
from siftmill.session import cut_lineage


@dataclass(frozen=True)
class JudgeLimits:
    """Fixed default thresholds of the rules."""

    primary: str = "auc"
    gap_tolerance: float = 0.05
    leak_auc: float = 0.75
    psi_warn: float = 0.10
    psi_severe: float = 0.25
    no_progress_rounds: int = 3
    budget_low: float = 0.15
    early_stop_frac: float = 0.05
    n_rounds_max: int = 500
    max_features: int = 60
    max_added: int = 40
    psi_margin: float = 0.002
    alpha_0: float = 0.05
    max_compares: int = 30
    delta: float = 0.02


def _at(df: DataFrame, name: str) -> Column:
    """The column, or NULL when this table does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None)


def overfit_gap(df: DataFrame, lim: JudgeLimits = JudgeLimits()) -> Column:
    """Gap beyond the reference's own gap plus tolerance; without a reference, beyond the metric's limit."""
    gap = F.col(f"valid_{lim.primary}") - F.col(f"oot_dev_{lim.primary}")
    ref = _at(df, "reference_gap").cast("double")
    return F.coalesce(F.when(ref.isNotNull(), gap - ref > lim.gap_tolerance).otherwise(gap > METRICS[lim.primary][1]), F.lit(False))


def too_many_features(df: DataFrame, lim: JudgeLimits = JudgeLimits()) -> Column:
    raw = _at(df, "n_raw_features").cast("int")
    return F.coalesce(F.when(raw.isNotNull(), F.col("n_features") - raw > lim.max_added).otherwise(F.col("n_features") > lim.max_features), F.lit(False))


def diagnose(df: DataFrame, lim: JudgeLimits = JudgeLimits()) -> DataFrame:
    """Add ``codes`` (array, fixed order) and ``psi_severity`` to every experiment.

    Columns read when present: ``reference_gap, leak_suspects, score_psi, no_progress,
    budget_left, model, best_iter, max_iter, data_fatal, oom``. ``max_iter`` is the model's own
    limit of iterations; without it the general one counts.
    """
    truth = lambda c: F.coalesce(c, F.lit(False))
    psi = _at(df, "score_psi").cast("double")
    tests = (
        ("OVERFIT_GAP", overfit_gap(df, lim)),
        ("LEAK_SUSPECT", truth(_at(df, "leak_suspects").cast("int") > 0)),
        ("PSI_DRIFT", truth(psi > lim.psi_warn)),
        ("NO_PROGRESS", truth(_at(df, "no_progress").cast("boolean"))),
        ("BUDGET_LOW", truth(_at(df, "budget_left").cast("double") < lim.budget_low)),
        ("NO_CONVERGE", truth((_at(df, "model").cast("string") == "gbt") & (_at(df, "best_iter").cast("int") < F.coalesce(_at(df, "max_iter").cast("int"), F.lit(lim.n_rounds_max)) * lim.early_stop_frac))),
        ("DATA_FATAL", truth(_at(df, "data_fatal").cast("boolean"))),
        ("OOM", truth(_at(df, "oom").cast("boolean"))),
    )
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))
    return df.withColumns({"codes": codes, "psi_severity": F.when(psi > lim.psi_severe, "severe").when(psi > lim.psi_warn, "warn")})


def guardrail_failures(df: DataFrame, guards: Mapping[str, float], lim: JudgeLimits = JudgeLimits()) -> Column:
    """Reasons that force a rejection; guards compare with the current best experiment."""
    has = lambda code: F.array_contains("codes", code)
    drops = [F.coalesce(F.col(f"best_oot_dev_{g}") - F.col(f"oot_dev_{g}") > tol, F.lit(False)) for g, tol in guards.items()]
    guard = F.lit(False)
    for d in drops:
        guard = guard | d
    return F.array_compact(F.array(
        F.when(has("OVERFIT_GAP"), "OVERFIT_GAP"), F.when(has("LEAK_SUSPECT"), "LEAK_SUSPECT"),
        F.when(too_many_features(df, lim), "TOO_MANY_FEATURES"),
        F.when(F.coalesce(F.col("score_psi") > lim.psi_severe, F.lit(False)), "SCORE_PSI"),
        F.when(F.col("best_exp_id").isNotNull() & guard, "GUARD_FAIL"),
    ))


def monotone_noninferior(df: DataFrame, lim: JudgeLimits = JudgeLimits()) -> Column:
    """A constrained model may replace the same unconstrained one, on the same features, when it is not
    worse and more stable. Feature lists are compared where both sides state one."""
    same = (F.col("model") == F.col("best_model")) & F.col("monotone") & ~F.coalesce(F.col("best_monotone"), F.lit(False))
    if "features" in df.columns and "best_features" in df.columns:
        same = same & F.col("features").eqNullSafe(F.col("best_features"))
    full = (F.col("fidelity") == "full") & (F.col("best_fidelity") == "full")
    stable = F.coalesce(F.col("score_psi"), F.lit(1.0)) < F.coalesce(F.col("best_score_psi"), F.lit(0.0)) - lim.psi_margin
    return F.coalesce(same & full & (F.col("ci_high") >= 0) & stable, F.lit(False))


def verdict(df: DataFrame, guards: Mapping[str, float] | None = None, lim: JudgeLimits = JudgeLimits()) -> DataFrame:
    """Add ``codes, failures, verdict``.

    One row per comparison: the candidate's columns, the best one's with prefix ``best_`` (all
    NULL for the first experiment of a task), and ``ci_low, ci_high``.
    """
    out = diagnose(df, lim)
    out = out.withColumn("failures", guardrail_failures(out, guards or {}, lim))
    first = F.col("best_exp_id").isNull()
    full, significant = F.col("fidelity") == "full", F.coalesce(F.col("ci_low") > 0, F.lit(False))
    result = (
        F.when(F.size("failures") > 0, "REJECT")
        .when(first, F.when(full, "ACCEPT").otherwise("PROMISING"))
        .when(monotone_noninferior(out, lim) & ~significant, "ACCEPT")
        .when(significant, F.when(full, "ACCEPT").otherwise("PROMISING"))
        .when(F.col("ci_high") < 0, "REJECT")
        .otherwise("INCONCLUSIVE")
    )
    plateau = F.when(~first & ~significant, F.array(F.lit("PLATEAU"))).otherwise(F.array().cast("array<string>"))
    guard = F.filter("failures", lambda f: f == "GUARD_FAIL")
    return out.withColumn("verdict", result).withColumn("codes", F.concat("codes", plateau, guard))


def best_so_far(exps: DataFrame, columns: Sequence[str], by: str = "task_id", order: str = "seq", score: str = "oot_dev_auc", buckets: int | None = None) -> DataFrame:
    """Attach the best earlier experiment of the task to each row, as ``best_<column>``; the
    earlier one wins a tie."""
    packed = F.struct(F.col(score), -F.col(order), *[F.col(c).alias(f"x_{c}") for c in columns])
    out = earlier_max(exps, [by], [order], packed, "_best", plan_buckets(exps, order, buckets))
    return out.withColumns({f"best_{c}": F.col(f"_best.x_{c}") for c in columns}).drop("_best")


def alpha_schedule(compares: DataFrame, task: str = "task_id", key: str = "exp_id", order: str = "seq", lim: JudgeLimits = JudgeLimits(), buckets: int | None = None) -> DataFrame:
    """Comparison number and significance level per ``(task, key)``.

    A repeated key reuses its number; past the cap the level is NULL because no further
    comparison is allowed.
    """
    first = compares.groupBy(task, key).agg(F.min(order).alias("first_use"))
    numbered = row_positions(first, [task], ["first_use", key], plan_buckets(compares, order, buckets), "k").withColumn("k", F.col("k") + 1)
    alpha = F.when(F.col("k") <= lim.max_compares, F.lit(lim.alpha_0) / (1 + F.ln(F.col("k"))))
    return numbered.select(task, key, "k", alpha.alias("alpha"))


def budget_alpha(k: int, alpha_0: float = 0.05) -> float:
    return alpha_0 / (1 + math.log(k))


def overfit_to_oot(df: DataFrame, delta: float = 0.02) -> DataFrame:
    """Drop from OOT to holdout beyond the reference model's own drop."""
    drop = F.col("oot_dev") - F.col("holdout")
    return df.withColumns({"drop": drop, "overfit": drop - F.coalesce(F.col("reference_drop"), F.lit(0.0)) > delta})


def history_mark(df: DataFrame, min_up: float = 0.0) -> DataFrame:
    """Inconclusive low-fidelity results that look better are marked and do not count as a standstill."""
    up = (F.col("verdict") == "INCONCLUSIVE") & (F.col("fidelity") == "low") & (F.col("delta") > max(min_up, 0.0))
    return df.withColumn("mark", F.when(F.coalesce(up, F.lit(False)), "INCONCLUSIVE_UP").otherwise(F.col("verdict")))


def no_progress(df: DataFrame, rounds: int = 3, task: str = "task_id", order: Sequence[str] = ("seq",), mark: str = "mark", buckets: int | None = None, chunk_rows: int = 1_000_000, final: Column | None = None) -> DataFrame:
    """True where the last ``rounds`` marks of the task are all REJECT or INCONCLUSIVE.

    ``final`` marks the rows that give the task a final model: before the first one nothing stops.
    """
    stuck = df.withColumn("_stuck", F.coalesce(F.col(mark).isin("REJECT", "INCONCLUSIVE"), F.lit(False)).cast("int"))
    make = {f"_s{k}": ("lag", ("_stuck", k)) for k in range(1, rounds)}
    seen = history_columns(stuck, [task], list(order), make, max(1, rounds - 1), plan_buckets(df, order[0], buckets), chunk_rows)
    streak = F.col("_stuck")
    for name in make:
        streak = streak + F.coalesce(F.col(name), F.lit(0))
    stopped = streak == rounds
    if final is not None:
        held = F.coalesce(final, F.lit(False)).cast("int")
        seen = running_totals(seen, [task], list(order), {"_final": held}, plan_buckets(df, order[0], buckets))
        stopped = stopped & (F.col("_final") > 0)
    return seen.withColumn("no_progress", stopped).drop("_stuck", "_final", *make)


def promotable(exps: DataFrame) -> DataFrame:
    """Low-fidelity experiments that were not rejected or invalidated and not promoted yet."""
    done = exps.where(F.col("action_type") == "PROMOTE_FIDELITY").select("task_id", F.col("target_exp_id").alias("exp_id"))
    open_ones = exps.where((F.col("fidelity") == "low") & F.col("verdict").isin("PROMISING", "INCONCLUSIVE") & ~F.col("invalidated"))
    return open_ones.join(done, ["task_id", "exp_id"], "left_anti")


def promote_candidates(exps: DataFrame) -> DataFrame:
    """Promotable experiments that looked better than what they were compared with: promising ones,
    and undecided ones with a better point estimate."""
    better = (F.col("verdict") == "PROMISING") | F.coalesce(F.col("delta") > 0, F.lit(False))
    return promotable(exps).where(better)


def decision_codes(exps: DataFrame, task: str = "task_id", order: str = "seq", rounds_left: str | None = None) -> DataFrame:
    """``task``, ``decision_codes``: the last experiment's ``codes`` and what the task as a whole calls for.

    NO_FINAL_MODEL: nothing is accepted at full fidelity, but something can be promoted; not asked for
    right after a promotion failed for OVERFIT_GAP, unless this is the last round (``rounds_left``
    below 2). PROMOTE_CANDIDATE: there is a final model and a better candidate not promoted yet.
    """
    final = (F.col("verdict") == "ACCEPT") & (F.col("fidelity") == "full") & ~F.coalesce(F.col("invalidated"), F.lit(False))
    left = F.col(rounds_left) if rounds_left else F.lit(None).cast("int")
    last = F.max_by(F.struct("codes", "action_type", left.alias("left")), order)
    tasks = exps.groupBy(task).agg(last.alias("_last"), (F.count_if(final) > 0).alias("_final"))
    can = promotable(exps).groupBy(task).agg(F.count("*").alias("_can"))
    wanted = promote_candidates(exps).groupBy(task).agg(F.count("*").alias("_wanted"))
    rows = tasks.join(can, task, "left").join(wanted, task, "left")
    gap_again = (F.col("_last.action_type") == "PROMOTE_FIDELITY") & F.array_contains("_last.codes", "OVERFIT_GAP") & F.coalesce(F.col("_last.left") >= 2, F.lit(True))
    more = F.array_compact(F.array(
        F.when(~F.col("_final") & F.col("_can").isNotNull() & ~F.coalesce(gap_again, F.lit(False)), "NO_FINAL_MODEL"),
        F.when(F.col("_final") & F.col("_wanted").isNotNull(), "PROMOTE_CANDIDATE"),
    ))
    return rows.select(task, F.concat(F.coalesce(F.col("_last.codes"), F.array().cast("array<string>")), more).alias("decision_codes"))


def top_experiments(exps: DataFrame, k: int, score: str = "oot_dev_auc") -> DataFrame:
    """The k best valid experiments per task; the planner limits each task before the shuffle."""
    w = Window.partitionBy("task_id").orderBy(F.col(score).desc(), "seq")
    return exps.where(F.col(score).isNotNull() & ~F.col("invalidated")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recent_rejected(exps: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy(F.col("seq").desc())
    return exps.where(F.col("verdict") == "REJECT").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def repeated_configs(exps: DataFrame) -> DataFrame:
    """Configurations tried more than once inside a task."""
    ok = exps.where(~F.col("invalidated") & (F.col("fidelity") != "none"))
    return ok.groupBy("task_id", "config_hash").agg(F.count("*").alias("n")).where("n > 1")


def invalidate(exps: DataFrame, condition: Column) -> DataFrame:
    """Mark experiments as no longer valid; nothing is deleted."""
    return exps.withColumn("invalidated", F.col("invalidated") | F.coalesce(condition, F.lit(False)))


def lineage(exps: DataFrame, starts: DataFrame) -> DataFrame:
    """Ancestors of the given experiments, ``(start_id, exp_id, depth)`` with depth 0 = itself.

    Pointer doubling: round k adds the ancestors at 2^k and more steps from those known, so a chain
    of any length takes its logarithm of joins. A cycle among the parents is an error.
    """
    ids = exps.select("exp_id").distinct()
    jump = exps.where("parent_exp_id is not null").select("exp_id", F.col("parent_exp_id").alias("up"))
    jump = cut_lineage(jump.join(ids.withColumnRenamed("exp_id", "up"), "up", "left_semi"))
    found = cut_lineage(starts.select(F.col("exp_id").alias("start_id"), "exp_id", F.lit(0).alias("depth")).join(ids, "exp_id", "left_semi"))
    steps, most = 1, ids.count()
    while True:
        more = found.join(jump, "exp_id").select("start_id", F.col("up").alias("exp_id"), (F.col("depth") + steps).alias("depth"))
        more = cut_lineage(more)
        if more.isEmpty():
            return found.select("start_id", "exp_id", "depth")
        if steps > most:
            raise ValueError("the parents of the experiments form a cycle")
        found = cut_lineage(found.select("start_id", "exp_id", "depth").unionByName(more))
        far = jump.select(F.col("exp_id").alias("up"), F.col("up").alias("_next"))
        jump = cut_lineage(jump.join(far, "up").select("exp_id", F.col("_next").alias("up")))
        steps *= 2


def roots(exps: DataFrame) -> DataFrame:
    """Root and depth of every experiment by pointer doubling: log2(depth) joins.

    A jump table keeps, for every experiment, an ancestor and its distance; composing the table
    with itself doubles the distance until everyone points at a root. A cycle is an error.
    """
    ids = exps.select(F.col("exp_id"), F.col("parent_exp_id"))
    parent = ids.join(ids.select(F.col("exp_id").alias("parent_exp_id"), F.lit(True).alias("_there")), "parent_exp_id", "left")
    jump = parent.select("exp_id", F.coalesce(F.when(F.col("_there"), F.col("parent_exp_id")), F.col("exp_id")).alias("root"), F.when(F.col("_there"), 1).otherwise(0).alias("depth"))
    reach, most = 1, ids.count()
    while True:
        far = jump.select(F.col("exp_id").alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_more"))
        step = cut_lineage(jump.join(far, "root").select("exp_id", F.col("_next").alias("root"), (F.col("depth") + F.col("_more")).alias("depth"), (F.col("_more") > 0).alias("_moved")))
        jump = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return jump
        reach *= 2
        if reach > 2 * most:
            raise ValueError("the parents of the experiments form a cycle")


def node_delta(exps: DataFrame, score: str = "oot_dev_auc") -> DataFrame:
    """Score minus the parent's score."""
    parent = exps.select(F.col("exp_id").alias("parent_exp_id"), F.col(score).alias("parent_score"))
    return exps.join(parent, "parent_exp_id", "left").withColumn("delta", F.col(score) - F.col("parent_score"))


# Scale of each fingerprint dimension and the distance beyond which nothing is reused.
FINGERPRINT_SCALES = {"log10_n_samples": 0.5, "n_features": 20.0, "bad_rate": 0.05, "missing_rate": 0.10, "time_span_months": 12.0}
MAX_DISTANCE = 2.0


def nearest_tasks(queries: DataFrame, stored: DataFrame, scales: Mapping[str, float] = FINGERPRINT_SCALES, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``task_id``, ``nearest``, ``distance``, ``cold_start``: the nearest other stored task of each query.

    Beyond ``max_distance`` it is a cold start: nothing is reused, but the distance is told; without
    any other task that is null too. A grid is searched in rounds of doubling radius. In a round the
    open queries meet the boxes of small cells in the neighbourhood; boxes that cannot hold the
    nearest point, by the largest distance to another box, are dropped before single points are
    looked at. A query is settled when its best distance lies within the radius, so dense regions
    are done in early rounds and only far queries see large cells. Of equal fingerprints two tasks
    are kept, which is enough to find another than one's own. A fingerprint with a null matches none.
    """
    dims = list(scales)
    grid = dims[:3]

    def scaled(df, prefix):
        base = df.withColumn("log10_n_samples", F.log10(F.greatest(F.col("n_samples"), F.lit(1))))
        return base.select(F.col("task_id").alias(f"{prefix}task"), *[(F.col(d).cast("double") / scales[d]).alias(f"{prefix}{d}") for d in dims])

    every = scaled(queries, "q_")
    points = scaled(stored, "s_").where(" and ".join(f"s_{d} is not null" for d in dims))
    same = Window.partitionBy(*[f"s_{d}" for d in dims]).orderBy("s_task")
    points = cut_lineage(points.withColumn("_k", F.row_number().over(same)).where("_k <= 2").drop("_k"))
    still = cut_lineage(every.where(" and ".join(f"q_{d} is not null" for d in dims)))
    reach = [F.max(x).alias(f"hi_{x}") for df in (points,) for x in df.columns[1:]] + [F.min(x).alias(f"lo_{x}") for x in points.columns[1:]]
    ends = points.agg(*reach).first()
    far = still.agg(*[F.max(f"q_{d}").alias(f"hi_{d}") for d in dims], *[F.min(f"q_{d}").alias(f"lo_{d}") for d in dims]).first()
    span = 0.0
    if ends[0] is not None and far[0] is not None:
        span = sum((max(ends[f"hi_s_{d}"], far[f"hi_{d}"]) - min(ends[f"lo_s_{d}"], far[f"lo_{d}"])) ** 2 for d in dims) ** 0.5

    found, radius = None, max_distance / 8
    while ends[0] is not None:
        cell = lambda c, size: F.floor(F.col(c) / size)
        fine = points.withColumns({f"f_{d}": cell(f"s_{d}", radius / 4) for d in grid})
        boxes = fine.groupBy(*[f"f_{d}" for d in grid]).agg(
            F.min("s_task").alias("one"), F.max("s_task").alias("two"), *[F.min(f"s_{d}").alias(f"lo_{d}") for d in dims], *[F.max(f"s_{d}").alias(f"hi_{d}") for d in dims])
        boxes = boxes.withColumns({f"c_{d}": F.floor(F.col(f"f_{d}") / 4) for d in grid})
        around = still
        for d in grid:
            around = around.withColumn(f"c_{d}", F.explode(F.array(*[cell(f"q_{d}", radius) + o for o in (-1, 0, 1)])))
        near = around.join(boxes, [f"c_{d}" for d in grid]).where("one != q_task or two != q_task")
        apart = lambda d: F.greatest(F.col(f"lo_{d}") - F.col(f"q_{d}"), F.col(f"q_{d}") - F.col(f"hi_{d}"), F.lit(0.0))
        most = lambda d: F.greatest(F.abs(F.col(f"q_{d}") - F.col(f"lo_{d}")), F.abs(F.col(f"q_{d}") - F.col(f"hi_{d}")))
        norm = lambda side: F.sqrt(sum((F.pow(side(d), 2) for d in dims), F.lit(0.0)))
        near = cut_lineage(near.select("q_task", *[f"q_{d}" for d in dims], *[f"f_{d}" for d in grid], norm(apart).alias("_low"), norm(most).alias("_high")))
        limit = near.groupBy("q_task").agg(F.min("_high").alias("_limit"))
        kept = near.join(limit, "q_task").where(F.col("_low") <= F.col("_limit") + 1e-9)
        dist = F.sqrt(sum((F.pow(F.col(f"q_{d}") - F.col(f"s_{d}"), 2) for d in dims), F.lit(0.0)))
        pairs = kept.join(fine, [f"f_{d}" for d in grid]).where("q_task != s_task").withColumn("_d", dist)
        best = pairs.groupBy("q_task").agg(F.min(F.struct("_d", "s_task")).alias("_b")).where(F.col("_b._d") <= radius)
        best = cut_lineage(best.select("q_task", F.col("_b.s_task").alias("near"), F.col("_b._d").alias("_d")))
        found = best if found is None else found.unionByName(best)
        still = cut_lineage(still.join(best, "q_task", "left_anti"))
        if radius > 2 * span or still.isEmpty():
            break
        radius *= 2
    if found is None:
        return every.select(F.col("q_task").alias("task_id"), F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("distance"), F.lit(True).alias("cold_start"))
    out = every.select("q_task").join(found, "q_task", "left")
    cold = F.coalesce(F.col("_d") > max_distance, F.lit(True))
    return out.select(F.col("q_task").alias("task_id"), F.when(~cold, F.col("near")).alias("nearest"), F.col("_d").alias("distance"), cold.alias("cold_start"))


def sanity_flags(contributions: DataFrame, min_share: float = 0.01, max_share: float = 0.4) -> DataFrame:
    """Checks on ``(exp_id, feature, share, corr, prior, incumbent)``: direction against the prior,
    one dominating feature."""
    against = (F.coalesce(F.col("prior"), F.lit(0)) != 0) & (F.abs("corr") > 0.1) & (F.signum("corr") != F.signum(F.col("prior").cast("double"))) & (F.col("share") >= min_share)
    return contributions.withColumns({"against_prior": F.coalesce(against, F.lit(False)), "dominates": F.col("share") > max_share})


def incumbent_share(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("exp_id").agg(F.sum(F.when(F.col("incumbent"), F.col("share")).otherwise(0.0)).alias("incumbent_share"))


def race_tie(scores: DataFrame, mde: float, preference: Sequence[str], by: str = "task_id", model: str = "model", score: str = "score") -> DataFrame:
    """Models within ``mde`` of the best tie; a fixed order picks one of them.

    The best score per task is an aggregate, the tied models are then reduced to the preferred one.
    """
    best = scores.groupBy(by).agg(F.max(score).alias("best_score"), F.max(F.struct(F.col(score), F.col(model))).alias("_b"))
    near = scores.join(best, by).where((F.col("best_score") - F.col(score) < mde) | (F.col(model) == F.col("_b")[model]))
    place = F.coalesce(*[F.when(F.col(model) == m, i) for i, m in enumerate(preference)], F.lit(len(preference)))
    pick = F.min(F.struct(place.alias("place"), (-F.col(score)).alias("neg"), F.col(model).alias("m")))
    out = near.groupBy(by).agg(pick.alias("_p"), F.count("*").alias("n_tied"), F.max(F.col("_b")[model]).alias("best"))
    return out.select(by, F.col("_p.m").alias("recommended"), "n_tied", "best")

