"""Models as Spark ML jobs: preparation, scorecard, tree ensembles, search, race, explanation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, SPLIT
from siftmill.operators import compare, metrics
from siftmill.operators.encoding import HOT, Encoder, Inputs, fit_encoder, prepare
from siftmill.operators.explain import contributions, explain
from siftmill.operators.screen import EDGE_ROW_BYTES, value_counts_by_label
from siftmill.plans.distribution import collapse, long_buckets, quantile_edges, right_closed_bin, text_long
from siftmill.plans.sizing import broadcast_bounded
from siftmill.plans.skew import hot_split_join
from siftmill.session import cut_lineage
from siftmill.sources.subset import fraction_sample

RARE, RARE_BELOW = "__rare__", 50


# ---- weight of evidence --------------------------------------------------------------------

def woe_table(train: DataFrame, inputs: Inputs, bins: int = 10, label: str = LABEL, buckets: int | None = None) -> DataFrame:
    """``(feature, kind, bin, level, edges, n, n_pos, woe)``.

    Numeric features get right-closed quantile bins (a feature with fewer than three edges is a
    single bin) and a missing bin; categories seen fewer than 50 times and missing ones share a level.
    Counts are smoothed with two rows at the overall rate.
    """
    parts, rows = [], prepare(train, inputs).where(F.col(label).isNotNull())
    if inputs.numbers:
        fs = inputs.numbers
        dist = value_counts_by_label(rows, fs, label)
        edges = quantile_edges(dist.where("value is not null"), ["feature"], bins, long_buckets(rows, fs, buckets))
        joined = dist.join(broadcast_bounded(edges, len(fs), EDGE_ROW_BYTES), "feature", "left")
        single = F.coalesce(F.size("edges") < 3, F.lit(True)) | (F.size("edges") < 0)
        number = F.when(F.col("value").isNull(), -1).when(single, 0).otherwise(right_closed_bin(F.col("edges"), F.col("value")))
        kept = F.when(single, F.array(F.lit(float("-inf")), F.lit(float("inf")))).otherwise(F.col("edges"))
        per = joined.withColumns({"bin": number, "_edges": kept}).groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), F.max("_edges").alias("edges"))
        parts.append(per.select("feature", F.lit("numeric").alias("kind"), "bin", F.lit(None).cast("string").alias("level"), "edges", "n", "n_pos"))
    if inputs.categorical:
        fs = list(inputs.categorical)
        dist = collapse(text_long(rows.withColumn("y", F.col(label)), fs, ["y"]), ["feature"])
        level = F.when(F.col("value").isNull() | (F.col("n") < RARE_BELOW), RARE).otherwise(F.col("value"))
        per = dist.groupBy("feature", level.alias("level")).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
        parts.append(per.select("feature", F.lit("text").alias("kind"), F.lit(None).cast("int").alias("bin"), "level", F.lit(None).cast("array<double>").alias("edges"), "n", "n_pos"))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    tot = table.groupBy("feature").agg((F.sum("n_pos").cast("double") / F.sum("n")).alias("_rate"), F.count("*").alias("_k"), F.sum("n").alias("_n"), F.sum("n_pos").alias("_p"))
    with_tot = table.join(broadcast_bounded(tot, len(inputs.names), 64), "feature")
    bad = F.col("n_pos") + 2 * F.col("_rate")
    good = F.col("n") - F.col("n_pos") + 2 * (1 - F.col("_rate"))
    all_bad = F.col("_p") + 2 * F.col("_rate") * F.col("_k")
    all_good = F.col("_n") - F.col("_p") + 2 * (1 - F.col("_rate")) * F.col("_k")
    return with_tot.withColumn("woe", F.ln((bad / all_bad) / (good / all_good))).drop("_rate", "_k", "_n", "_p")


def woe_transform(df: DataFrame, inputs: Inputs, table: DataFrame) -> DataFrame:
    """Replace each feature by its WOE in ``<feature>__woe``.

    Values outside the training range fall into the missing bin; a bin or level never seen is 0.
    Numeric bins are literals (features x bins numbers); category levels are joined.
    """
    out = prepare(df, inputs)
    rows = table.where("kind = 'numeric'").select("feature", "bin", "edges", "woe").collect() if inputs.numbers else []
    made = {}
    for f in inputs.numbers:
        own = [r for r in rows if r["feature"] == f]
        woe = {r["bin"]: r["woe"] for r in own}
        edges = max((r["edges"] for r in own if r["edges"]), key=len, default=[])
        x, cells = F.col(f), F.lit(woe.get(-1, 0.0))
        if edges:
            inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
            at = F.size(F.filter(inner, lambda e: e < x))
            values = F.array(*[F.lit(float(woe.get(i, 0.0))) for i in range(len(edges) - 1)])
            inside = x.isNotNull() & (x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1])))
            cells = F.when(inside, F.element_at(values, at + 1)).otherwise(F.lit(float(woe.get(-1, 0.0))))
        made[f"{f}__woe"] = cells
    out = out.withColumns(made) if made else out
    texts = table.where("kind = 'text'")
    total = texts.groupBy("feature").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] if inputs.categorical else 0
    for f in inputs.categorical:
        own = texts.where(F.col("feature") == f)
        level = own.select(F.col("level").alias(f"_l_{f}"), F.col("woe").alias(f"_w_{f}"), (F.col("n") > HOT * (total or 0)).alias("_often"))
        rare = level.where(F.col(f"_l_{f}") == RARE).select(F.col(f"_w_{f}")).collect()  # at most one row
        other = float(rare[0][0]) if rare else 0.0
        # At most 1 / HOT levels can be that frequent.
        hit = hot_split_join(out.withColumn(f"_l_{f}", F.col(f).cast("string")), level, [f"_l_{f}"], F.col("_often"), int(1 / HOT), ID)
        value = F.coalesce(F.col(f"_w_{f}"), F.lit(other))
        out = hit.withColumn(f"{f}__woe", value).drop(f"_l_{f}", f"_w_{f}", "_often")
    return out


# ---- model registry ------------------------------------------------------------------------

@dataclass
class Fitted:
    """A trained model: ``score(df)`` adds the probability ``p``."""

    name: str
    inputs: Inputs
    transform: Callable[[DataFrame], DataFrame]
    model: object
    info: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.transform(df))
        keep = [c for c in df.columns if c not in ("p", "rawPrediction", "probability", "prediction")]
        return scored.select(*keep, vector_to_array("probability")[1].alias("p"))


MODELS: dict[str, Callable[..., Fitted]] = {}
#: Models that take a fitted encoder among their parameters.
ENCODED = ("gbt", "random_forest")
SPACES: dict[str, dict] = {}


def model(name: str, space: Mapping[str, Mapping]):
    """Register a model builder ``(train, valid, inputs, params, seed) -> Fitted`` and its search space."""

    def register(builder):
        MODELS[name], SPACES[name] = builder, dict(space)
        return builder

    return register


@model("scorecard", {"C": {"low": 1e-3, "high": 10.0, "log": True}, "n_bins": {"low": 5, "high": 20, "type": "int"}})
def fit_scorecard(train: DataFrame, valid: DataFrame | None, inputs: Inputs, params: Mapping, seed: int = 0) -> Fitted:
    """WOE bins plus logistic regression with an L2 penalty of 1 / (C n)."""
    table = cut_lineage(woe_table(train, inputs, int(params.get("n_bins", 10))))
    columns = [f"{c}__woe" for c in inputs.names]
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    transform = lambda df: assembler.transform(woe_transform(df, inputs, table))
    n = train.count()
    lr = LogisticRegression(labelCol=LABEL, regParam=1.0 / (float(params.get("C", 1.0)) * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=100)
    fitted = lr.fit(transform(train))
    return Fitted("scorecard", inputs, transform, fitted, {"woe": table, "woe_transform": lambda df: woe_transform(df, inputs, table), "n": n, "coef": dict(zip(inputs.names, fitted.coefficients.toArray().tolist()))})


def encoder_for(train: DataFrame, inputs: Inputs, params: Mapping) -> Encoder:
    """The encoder given with the parameters, or a new one for these rows."""
    return params.get("encoder") or fit_encoder(train, inputs, int(params.get("max_bins", 64)))


@model("gbt", {"max_depth": {"low": 2, "high": 8, "type": "int"}, "step_size": {"low": 0.02, "high": 0.3, "log": True}, "min_instances": {"low": 5, "high": 200, "type": "int", "log": True}, "subsampling": {"low": 0.5, "high": 1.0}})
def fit_gbt(train: DataFrame, valid: DataFrame | None, inputs: Inputs, params: Mapping, seed: int = 0) -> Fitted:
    """Boosted trees that stop when the validation rows no longer improve."""
    encoder = encoder_for(train, inputs, params)
    limit = int(params.get("max_iter", 20))
    gbt = GBTClassifier(
        labelCol=LABEL, maxIter=limit, maxDepth=int(params.get("max_depth", 5)), stepSize=float(params.get("step_size", 0.1)),
        minInstancesPerNode=int(params.get("min_instances", 20)), subsamplingRate=float(params.get("subsampling", 1.0)), maxBins=int(params.get("max_bins", 64)), seed=seed,
        validationTol=float(params.get("validation_tol", 0.005)),
    )
    rows = encoder.transform(train, F.lit(True)).select(LABEL, "features", F.lit(False).alias("is_valid"))
    if valid is not None:
        gbt = gbt.setValidationIndicatorCol("is_valid")
        rows = rows.unionByName(encoder.transform(valid, F.lit(False)).select(LABEL, "features", F.lit(True).alias("is_valid")))
    fitted = gbt.fit(cut_lineage(rows))  # a fit reads its rows several times
    return Fitted("gbt", inputs, encoder.transform, fitted, {"best_iter": fitted.getNumTrees, "max_iter": limit, "encoder": encoder})


@model("random_forest", {"n_trees": {"low": 20, "high": 200, "type": "int"}, "max_depth": {"low": 4, "high": 14, "type": "int"}, "min_instances": {"low": 1, "high": 50, "type": "int"}})
def fit_forest(train: DataFrame, valid: DataFrame | None, inputs: Inputs, params: Mapping, seed: int = 0) -> Fitted:
    encoder = encoder_for(train, inputs, params)
    rf = RandomForestClassifier(labelCol=LABEL, numTrees=int(params.get("n_trees", 20)), maxDepth=int(params.get("max_depth", 6)), minInstancesPerNode=int(params.get("min_instances", 5)), maxBins=int(params.get("max_bins", 64)), seed=seed)
    fitted = rf.fit(cut_lineage(encoder.transform(train, F.lit(True)).select(LABEL, "features")))
    return Fitted("random_forest", inputs, encoder.transform, fitted, {"encoder": encoder})


# ---- experiments ---------------------------------------------------------------------------

def predictions(fitted: Fitted, df: DataFrame, exp_id: str) -> DataFrame:
    """Keyed predictions ``(exp_id, split, _row_id, y, p)``."""
    return fitted.score(df).select(F.lit(exp_id).alias("exp_id"), SPLIT, ID, F.col(LABEL).alias("y"), "p")


def run_experiment(exp_id: str, name: str, splits: DataFrame, inputs: Inputs, params: Mapping | None = None, fraction: float = 1.0, min_rows: int = 0, seed: int = 0) -> tuple[Fitted, DataFrame]:
    """Fit on train (stopping on valid) and predict every open split.

    A low-fidelity run trains on a hash sample with a floor on its size; OOT rows are always all
    scored.
    """
    train, valid = splits.where(F.col(SPLIT) == "train"), splits.where(F.col(SPLIT) == "valid")
    if fraction < 1:
        train, valid = fraction_sample(train, ID, fraction, min_rows, seed), fraction_sample(valid, ID, fraction, min_rows, seed)
    fitted = MODELS[name](train, valid, inputs, dict(params or {}), seed)
    return fitted, cut_lineage(predictions(fitted, splits, exp_id))


def experiment_metrics(preds: DataFrame, primary: str = "auc") -> DataFrame:
    """Metrics per experiment and split with the gap and the score PSI from valid to OOT."""
    base = metrics.all_metrics(preds, primary=primary)
    two = preds.where(F.col(SPLIT).isin("valid", "oot_dev"))
    shift = metrics.population_shift(two, F.col(SPLIT) == "valid", ["exp_id"]).withColumnRenamed("psi", "score_psi")
    return base.join(shift, "exp_id", "left")


@dataclass(frozen=True)
class Choice:
    """A parameter that takes one of the given values."""

    choices: tuple

    def clip(self, value):
        return value

    def sample(self, rng: np.random.Generator):
        return self.choices[int(rng.integers(len(self.choices)))]


@dataclass(frozen=True)
class Range:
    """A parameter between two bounds, drawn evenly or evenly in its logarithm."""

    low: float
    high: float
    log: bool = False
    type: str = "float"

    def clip(self, value):
        return self.low if value < self.low else self.high if value > self.high else value

    def sample(self, rng: np.random.Generator):
        drawn = np.exp(rng.uniform(np.log(self.low), np.log(self.high))) if self.log else rng.uniform(self.low, self.high)
        return int(round(drawn)) if self.type == "int" else float(drawn)


def parameters(space: Mapping[str, Mapping]) -> dict[str, Choice | Range]:
    return {name: Choice(tuple(said["choices"])) if "choices" in said else Range(**said) for name, said in space.items()}


def search_points(space: Mapping[str, Mapping], n_trials: int, seed: int, warm: Sequence[Mapping] = (), warm_share: float = 0.10) -> list[dict]:
    """Warm points, moved into the space and without unknown parameters, for at most a tenth of the
    trials; then seeded random ones."""
    known, rng = parameters(space), np.random.default_rng(seed)
    points = [{name: known[name].clip(point[name]) for name in known.keys() & point.keys()} for point in warm[: int(n_trials * warm_share)]]
    while len(points) < n_trials:
        points.append({name: p.sample(rng) for name, p in known.items()})
    return points


def param_search(
    name: str, splits: DataFrame, inputs: Inputs, n_trials: int, seed: int = 0, space: Mapping | None = None, warm: Sequence[Mapping] = (), metric: str = "auc",
    parallelism: int = 2, rungs: int = 1, keep: float = 1 / 3, min_rows: int = 2000,
) -> tuple[dict, list[tuple[dict, float | None]]]:
    """Best parameters by the metric on the validation rows, and ``(parameters, metric)`` of every trial.

    With more than one rung the candidates start on a nested hash sample of the training rows, each
    rung takes ``1 / keep`` times as many rows and only the best ``keep`` of the candidates, and the
    last one all rows. A trial that leaves the race keeps its last value. Tree models share one
    encoder, fitted once on all training rows; the rows of a rung are written once. A trial whose
    metric is not defined has the value None and loses against every other.
    """
    train, valid = splits.where(F.col(SPLIT) == "train"), splits.where(F.col(SPLIT) == "valid")
    shared = {"encoder": fit_encoder(train, inputs)} if name in ENCODED else {}
    done: list[tuple[dict, float | None]] = [(p, None) for p in search_points(space or SPACES[name], n_trials, seed, warm)]
    rank = lambda i: (done[i][1] is None, -(done[i][1] or 0.0), i)
    alive = list(range(len(done)))
    for rung in range(rungs):
        share = keep ** (rungs - 1 - rung)
        rows = cut_lineage(fraction_sample(train, ID, share, min_rows, seed)) if share < 1 else train

        def trial(i, rows=rows):
            fitted = MODELS[name](rows, valid, inputs, {**done[i][0], **shared}, seed)
            row = metrics.METRICS[metric][0](predictions(fitted, valid, "trial"), ["exp_id"]).first()
            return None if row is None or row[metric] is None else float(row[metric])

        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for i, value in zip(alive, list(pool.map(trial, alive)), strict=True):
                done[i] = (done[i][0], value)
        alive.sort(key=rank)
        if rung < rungs - 1:
            alive = alive[: max(1, int(np.ceil(len(alive) * keep)))]
    return done[alive[0]][0], done


def model_race(models: Sequence[str], splits: DataFrame, inputs: Inputs, fraction: float = 1.0, min_rows: int = 0, seed: int = 0, params: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Predictions of every model on the same splits; ``exp_id`` is the model name."""
    out = None
    for name in models:
        _, preds = run_experiment(name, name, splits, inputs, (params or {}).get(name), fraction, min_rows, seed)
        out = preds if out is None else out.unionByName(preds)
    return out


def masked(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The same rows with some fields missing, types unchanged."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({f: F.lit(None).cast(kinds[f]) for f in fields if f in kinds})


def holdout_result(fitted: Fitted, rows: DataFrame, oot_score: float, reference_drop: float | None = None, mask: Sequence[str] = (), primary: str = "auc", delta: float = 0.02) -> DataFrame:
    """Final numbers on the holdout: metrics, drop against OOT, masked AUC."""
    scored = fitted.score(rows).withColumn("g", F.lit("holdout")).withColumnRenamed(LABEL, "y")
    out = metrics.ranking_metrics(scored, ["g"])
    top = metrics.top_decile(scored, ["g"]).select("g", "lift_top10", "recall_top10")
    out = out.join(top, "g").join(metrics.brier(scored, ["g"]), "g")
    drop = F.lit(float(oot_score)) - F.col(primary)
    out = out.withColumns({"oot_dev": F.lit(float(oot_score)), "drop": drop, "overfit_to_oot": drop - F.lit(float(reference_drop or 0.0)) > delta})
    if mask:
        hidden = fitted.score(masked(rows, mask)).withColumn("g", F.lit("holdout")).withColumnRenamed(LABEL, "y")
        out = out.join(metrics.auc(hidden, ["g"]).select("g", F.col("auc").alias("auc_masked")), "g")
    return out.drop("g")


# ---- monotone rules ------------------------------------------------------------------------

def merged_priors(table: Mapping[str, object], aliases: Mapping[str, str] | None = None, definitions: DataFrame | Sequence[Mapping] = ()) -> dict[str, int]:
    """Monotone priors by feature: those of generated features (``name``, ``prior``) win over the table's
    own, and these over a name that is only an alias of one of the table. Only whole numbers of the
    table count; one row a feature."""
    stated = {f: d for f, d in table.items() if isinstance(d, int) and not isinstance(d, bool)}
    out = {f: stated[known] for f, known in (aliases or {}).items() if known in stated}
    out.update(stated)
    rows = definitions.where("prior is not null").select("name", "prior").collect() if isinstance(definitions, DataFrame) else definitions
    out.update({d["name"]: int(d["prior"]) for d in rows if d["prior"] is not None})
    return out


def monotone_guard(df: DataFrame, features: Sequence[str], priors: Mapping[str, int], categorical: Sequence[str] = (), min_rho: float = 0.01, label: str = LABEL, buckets: int | None = None) -> DataFrame:
    """``(feature, decision, rho)``: which features may carry a monotone constraint.

    A prior that the training data clearly contradicts is not imposed.
    """
    dist = value_counts_by_label(df, list(features), label)
    rho = metrics.spearman_with_label(dist, ["feature"], long_buckets(df, list(features), buckets)).select("feature", "rho")
    facts = [(f, priors.get(f)) for f in features]
    meta = df.sparkSession.createDataFrame(facts, "feature string, prior int")
    joined = meta.join(rho, "feature", "left")
    against = (F.abs("rho") >= min_rho) & ((F.col("rho") > 0) != (F.col("prior") > 0))
    decision = F.when(F.col("prior").isNull(), "no_prior").when(F.col("prior") == 0, "zero_prior").when(F.coalesce(against, F.lit(False)), "disagree").otherwise("constrained")
    out = joined.select("feature", decision.alias("decision"), "rho")
    if categorical:
        text = df.sparkSession.createDataFrame([(c,) for c in categorical], "feature string").select("feature", F.lit("categorical").alias("decision"), F.lit(None).cast("double").alias("rho"))
        out = out.unionByName(text)
    return out


def monotone_bins(table: DataFrame, feature: str, increasing: bool = True) -> DataFrame:
    """Monotone event rate over the bins of one feature: isotonic regression on bin rates."""
    own = table.where((F.col("feature") == feature) & (F.col("bin") >= 0))
    rows = own.select("bin", (F.col("n_pos").cast("double") / F.col("n")).alias("rate"), F.col("n").cast("double").alias("weight"), F.col("bin").cast("double").alias("features"))
    iso = IsotonicRegression(labelCol="rate", featuresCol="features", weightCol="weight", isotonic=increasing).fit(rows)
    return iso.transform(rows).select(F.lit(feature).alias("feature"), "bin", "rate", F.col("prediction").alias("monotone_rate"))


# ---- user code and aggregate gain ----------------------------------------------------------

def apply_user_code(df: DataFrame, function: Callable, schema: str, max_features: int = 5) -> DataFrame:
    """Run caller-supplied vectorised code over batches and return ``(_row_id, new columns)``.

    ``function`` gets a pandas batch and returns one holding ``_row_id`` and its new columns. It
    sees one batch at a time: statistics of a whole column must be passed in as constants. Every
    batch must come back with exactly its own row ids.
    """
    new = [part.split()[0] for part in schema.split(",") if part.split()[0] != ID]
    if not new or len(new) > max_features:
        raise ValueError(f"user code must produce 1 to {max_features} columns, got {len(new)}")

    def run(batches):
        for batch in batches:
            out = function(batch)
            if len(out) != len(batch) or set(out[ID]) != set(batch[ID]):
                raise ValueError("user code changed the row ids")
            yield out[[ID, *new]]

    return df.mapInPandas(run, schema)


def agg_gain(splits: DataFrame, base: Inputs, extra: Inputs, seed: int = 0, alpha: float = 0.05, n: int = 1000, params: Mapping | None = None) -> DataFrame:
    """What extra features add: AUC with and without them, bootstrap interval and detectable size."""
    _, small = run_experiment("base", "gbt", splits, base, params, seed=seed)
    _, large = run_experiment("extended", "gbt", splits, extra, params, seed=seed)
    oot = small.unionByName(large).where(F.col(SPLIT) == "oot_dev")
    pairs = compare.pair_predictions(oot, "extended", "base")
    result = compare.paired_bootstrap(pairs, alpha, n, seed)
    se = metrics.oot_power(oot.where(F.col("exp_id") == "base"), ["exp_id"], alpha=alpha).select("auc_se", "mde")
    return result.join(F.broadcast(se))  # one row each

