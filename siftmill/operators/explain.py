"""What each feature adds to each prediction, and its direction.

Tree ensembles get exact Shapley values along the trees' own paths: a feature that is not known is
followed down both branches in the proportion of the training rows. A leaf's value is shared among
the features on its path only, and what a feature gets depends on nothing but which of the path's
conditions the row meets, so every leaf becomes one small table over these patterns. Rows are
looked up in the tables in Arrow batches. Contributions and the base add up to the model's margin:
half the log odds of boosted trees, the probability of a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.columns import ID, OBS
from siftmill.operators import metrics
from siftmill.operators.encoding import Encoder, level_codes, prepare
from siftmill.operators.inject import hash_positions
from siftmill.plans.distribution import pair_corr
from siftmill.plans.sizing import broadcast_bounded
from siftmill.session import scratch_folder

#: Tree models whose own paths are used, and what turns a leaf's statistics into its value.
TREES = ("gbt", "random_forest")


@dataclass(frozen=True)
class Leaf:
    """One leaf: its path's conditions by feature and what each pattern of met conditions gives."""

    features: tuple[int, ...]
    #: Per feature: lowest excluded and highest included value, or categories that do and do not pass.
    low: np.ndarray
    high: np.ndarray
    categories: tuple[tuple[frozenset | None, frozenset], ...]
    #: Contribution of each feature by pattern: ``2 ** len(features)`` rows.
    table: np.ndarray
    expected: float


def path_table(value: float, shares: np.ndarray) -> np.ndarray:
    """Shapley value of every feature of a path for every pattern of met conditions.

    ``shares`` are the proportions of training rows that follow the path at a feature's splits. A
    coalition S is worth ``value`` times 1 or 0 for its members and the share for the others.
    """
    d = len(shares)
    met = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    out = np.zeros((1 << d, d))
    for j in range(d):
        rest = [k for k in range(d) if k != j]
        poly = np.ones((1 << d, 1))  # by the number of members of the coalition
        for k in rest:
            grown = np.zeros((1 << d, poly.shape[1] + 1))
            grown[:, :-1] += poly * shares[k]
            grown[:, 1:] += poly * met[:, [k]]
            poly = grown
        weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
        out[:, j] = value * (met[:, j] - shares[j]) * (poly @ weights)
    return out


def tree_leaves(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    """Leaves of one tree from its stored nodes (by id); ``weight`` scales their values."""
    out, stack = [], [(0, {}, 1.0)]
    while stack:
        at, path, reach = stack.pop()
        node = nodes[at]
        if node["left"] < 0:
            names = tuple(path)
            shares = np.array([path[f][0] for f in names])
            low, high = (np.array([path[f][i] for f in names]) for i in (1, 2))
            out.append(Leaf(names, low, high, tuple(path[f][3] for f in names), path_table(weight * node["value"], shares), weight * node["value"] * reach))
            continue
        f, split = node["feature"], node["split"]
        for child, left in ((node["left"], True), (node["right"], False)):
            share = nodes[child]["n"] / node["n"] if node["n"] else 0.5
            z, low, high, (inside, outside) = path.get(f, (1.0, -np.inf, np.inf, (None, frozenset())))
            if node["categories"] >= 0 and left:
                inside = frozenset(split) if inside is None else inside & frozenset(split)
            elif node["categories"] >= 0:
                outside = outside | frozenset(split)
            elif left:
                high = min(high, split[0])
            else:
                low = max(low, split[0])
            stack.append((child, {**path, f: (z * share, low, high, (inside, outside))}, reach * share))
    return out


def ensemble_leaves(model, name: str) -> list[Leaf]:
    """Leaves of all trees of a fitted ensemble, read from its stored form: as many rows as it has nodes."""
    spark = SparkSession.getActiveSession()
    folder = scratch_folder(spark, "trees")
    model.save(folder)
    rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    weights = model.treeWeights if name == "gbt" else [1.0 / model.getNumTrees] * model.getNumTrees
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        stats, split = r["impurityStats"], r["split"]
        share = stats[1] / sum(stats) if name != "gbt" and sum(stats) else 0.0
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "value": r["prediction"] if name == "gbt" else share, "n": stats[0] if name == "gbt" else sum(stats), "left": r["leftChild"], "right": r["rightChild"],
            "feature": split["featureIndex"], "split": split["leftCategoriesOrThreshold"], "categories": split["numCategories"],
        }
    return [leaf for t, nodes in sorted(trees.items()) for leaf in tree_leaves(nodes, weights[t])]


def shapley(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Contribution of every feature to every row of ``x``."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        pattern = np.zeros(len(x), np.int64)
        for k, (f, (inside, outside)) in enumerate(zip(leaf.features, leaf.categories, strict=True)):
            column = x[:, f]
            if inside is None and not outside:
                met = (column > leaf.low[k]) & (column <= leaf.high[k])
            else:
                met = ~np.isin(column, list(outside))
                met &= np.isin(column, list(inside)) if inside is not None else True
            pattern |= met.astype(np.int64) << k
        if leaf.features:
            out[:, list(leaf.features)] += leaf.table[pattern]
    return out


def tree_contributions(fitted, rows: DataFrame) -> DataFrame:
    """``(_row_id, base, margin, feature, x, contribution)`` of a fitted tree ensemble.

    ``x`` is the feature as the model sees it before missing numbers are filled: numbers and months
    as they are, categories by their place in the alphabet, or by their rate where they have too
    many levels. A missing number has no ``x`` but a contribution.
    """
    encoder: Encoder = fitted.info["encoder"]
    leaves, names = ensemble_leaves(fitted.model, fitted.name), list(encoder.inputs.names)
    base = float(sum(leaf.expected for leaf in leaves))
    scored = fitted.model.transform(encoder.transform(rows))
    margin = vector_to_array("rawPrediction" if fitted.name == "gbt" else "probability")[1]
    seen = F.array(*[F.col(c).cast("double") for c in [*encoder.inputs.numbers, *encoder.columns[len(encoder.inputs.numbers) :]]])
    types = f"{ID} {rows.schema[ID].dataType.simpleString()}, base double, margin double, seen array<double>, parts array<double>"
    schema = T.StructType.fromDDL(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, len(names))
            parts = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(names), pa.int32()), pa.array(shapley(leaves, x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(np.full(batch.num_rows, base)), batch.column("margin"), batch.column("seen"), parts], names=[ID, "base", "margin", "seen", "parts"])

    found = scored.select(ID, margin.alias("margin"), seen.alias("seen"), vector_to_array("features").alias("x")).mapInArrow(run, schema)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("seen").alias("x"), F.col("parts").alias("contribution"))
    return found.select(ID, "base", "margin", F.explode(named).alias("i")).select(ID, "base", "margin", F.col("i.feature"), F.col("i.x"), F.col("i.contribution"))


def swapped_contributions(fitted, rows: DataFrame, seed: int = 0) -> DataFrame:
    """``(_row_id, feature, x, contribution)`` of any model: each feature in turn is taken from another
    random row, and the contribution is how much the prediction changes."""
    inputs = fitted.inputs
    names = inputs.names
    keep = rows.select(ID, *([OBS] if OBS in rows.columns else []), *names)
    told = level_codes(keep, list(inputs.categorical))
    base = told.select(*keep.columns, *[F.col(f"_code_{c}") for c in inputs.categorical])
    other = hash_positions(base.select(ID, F.struct(*names).alias("_other")), ID, f"{seed}b").select("_pos", "_other")
    paired = hash_positions(base, ID, f"{seed}a").join(other, "_pos")
    numbers = prepare(paired, inputs)
    originals = {f"_x_{f}": F.col(f"_code_{f}") if f in inputs.categorical else F.col(f) for f in names}
    marked = paired.join(numbers.select(ID, *[x.alias(c) for c, x in originals.items()]), ID)
    swapped = marked.withColumn("feature", F.explode(F.array(F.lit(""), *[F.lit(f) for f in names])))
    changed = {f: F.when(F.col("feature") == f, F.col(f"_other.{f}")).otherwise(F.col(f)) for f in names}
    scored = fitted.score(swapped.withColumns(changed))
    truth = scored.where("feature = ''").select(ID, F.col("p").alias("_p0"))
    x = F.coalesce(*[F.when(F.col("feature") == f, F.col(f"_x_{f}")) for f in names])
    return scored.where("feature != ''").join(truth, ID).select(ID, "feature", x.alias("x"), (F.col("_p0") - F.col("p")).alias("contribution"))


def scorecard_contributions(fitted, rows: DataFrame) -> DataFrame:
    """WOE times coefficient."""
    inputs = fitted.inputs
    out = fitted.info["woe_transform"](level_codes(rows, list(inputs.categorical)))
    x = lambda f: F.col(f"_code_{f}") if f in inputs.categorical else F.col(f).cast("double")
    items = F.array(*[F.struct(F.lit(f).alias("feature"), x(f).alias("x"), (F.col(f"{f}__woe") * F.lit(fitted.info["coef"][f])).alias("contribution")) for f in inputs.names])
    return out.select(ID, F.explode(items).alias("i")).select(ID, "i.*")


def contributions(fitted, rows: DataFrame, seed: int = 0) -> DataFrame:
    """``(_row_id, feature, x, contribution)``: exact for scorecards and tree ensembles, by swapping
    values for other registered models. Text features are ordered by the alphabet."""
    if fitted.name == "scorecard":
        return scorecard_contributions(fitted, rows)
    if fitted.name in TREES:
        return tree_contributions(fitted, rows).drop("base", "margin")
    return swapped_contributions(fitted, rows, seed)


def explain(contribs: DataFrame, n_features: int, buckets: int | None = None) -> DataFrame:
    """Share of the mean absolute contribution, over all rows, and rank correlation with the feature
    value, over the rows that have one."""
    size = contribs.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("imp"))
    total = size.agg(F.sum("imp").alias("_all"))
    share = size.join(F.broadcast(total)).select("feature", F.coalesce(F.try_divide("imp", "_all"), F.lit(0.0)).alias("share"))  # one row
    known = contribs.where("x is not null and contribution is not null")
    rx = metrics.midranks(known, ["feature"], "x", buckets).select("feature", "x", F.col("midrank").alias("rx"))
    rc = metrics.midranks(known, ["feature"], "contribution", buckets).select("feature", "contribution", F.col("midrank").alias("rc"))
    rho = known.join(rx, ["feature", "x"]).join(rc, ["feature", "contribution"]).groupBy("feature").agg(pair_corr("rx", "rc").alias("corr"))
    return share.join(broadcast_bounded(rho, n_features, 64), "feature", "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))
