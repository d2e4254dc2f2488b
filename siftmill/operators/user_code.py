"""User code as a registered feature set: run, screened, recorded.

Code sees the columns it may use, on the open splits only. Its columns pass the screening funnel,
and what became of each, what went in and from which files is written next to the features. The
manifest comes last: a set without one does not count as registered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.columns import ID, LABEL, OBS, SPLIT
from siftmill.operators.models import apply_user_code
from siftmill.operators.registry import FeatureStore
from siftmill.operators.screen import ScreenLimits, screen
from siftmill.session import cut_lineage
from siftmill.sources.tables import path_exists

OPEN = ("train", "valid", "oot_dev")
MANIFEST = "fs_id string, code_sha1 string, column string, outcome string, reason string, inputs array<string>, sources array<struct<path:string,columns:array<string>>>, n_rows long"


def sources_of(df: DataFrame) -> list[tuple[str, list[str]]]:
    """The files or tables a table is made from, with the columns read of each, from its plan."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    out: dict[str, set[str]] = {}
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        names = {leaf.output().apply(i).name() for i in range(leaf.output().size())}
        try:
            roots = leaf.relation().location().rootPaths()
            place = ",".join(sorted(roots.apply(i).toString() for i in range(roots.size())))
        except Exception:  # noqa: BLE001 - leaves that are no files have only a name
            place = leaf.nodeName()
        out.setdefault(place, set()).update(names)
    return sorted((place, sorted(names)) for place, names in out.items())


def register_user_code(
    store: FeatureStore, splits: DataFrame, code: str, function: Callable, schema: str, inputs: Sequence[str] | None = None,
    label: str = LABEL, limits: ScreenLimits = ScreenLimits(), max_features: int = 5, buckets: int | None = None,
) -> DataFrame:
    """Run ``function`` (see ``apply_user_code``) on the open splits and register what it makes; the manifest.

    ``code`` is the text that names the set. ``inputs`` are the columns the code may see, besides row
    id and observation time; without them it sees all but label and split, and its columns are marked
    as of unknown availability. A set that is complete is not run again.
    """
    fs_id = "fs_code_" + hashlib.sha1(code.encode()).hexdigest()[:10]
    path = f"{store.root}/manifest/{fs_id}"
    if path_exists(store.spark, f"{path}/_SUCCESS"):
        return store.spark.read.parquet(path)
    rows = splits.where(F.col(SPLIT).isin(*OPEN))
    seen = [c for c in splits.columns if c not in (label, SPLIT, ID)] if inputs is None else [c for c in (OBS, *inputs) if c in splits.columns]
    made = None
    for name in OPEN:
        part = apply_user_code(rows.where(F.col(SPLIT) == name).select(ID, *dict.fromkeys(seen)), function, schema, max_features).withColumn(SPLIT, F.lit(name))
        made = part if made is None else made.unionByName(part)
    made = cut_lineage(made)
    columns = [c for c in made.columns if c not in (ID, SPLIT)]
    labelled = cut_lineage(made.join(rows.select(ID, SPLIT, F.col(label).alias(LABEL)), [ID, SPLIT]))
    found = screen(labelled.where(F.col(SPLIT) == "train"), labelled.where(F.col(SPLIT) == "oot_dev"), columns, limits=limits, buckets=buckets)
    known = "inputs known at prediction time" if inputs is not None else "availability unknown: needs approval"
    store.register(fs_id, made, [{"name": c, "expr": "user code", "window": "n/a", "prior": None, "template": "user_code", "rationale": known, "source": "user_code"} for c in columns], found.kept)
    kinds = {r["feature"]: r["outcome"] for r in found.table.collect()}  # one row a column
    reasons = {**found.dropped, **{c: f"auc {v:.4f}" for c, v in found.leak_suspect.items()}}
    said = (list(inputs) if inputs is not None else None, sources_of(rows.select(ID, *dict.fromkeys(seen))), made.count())
    sha = hashlib.sha1(code.encode()).hexdigest()
    store.spark.createDataFrame([(fs_id, sha, c, kinds[c], reasons.get(c), *said) for c in columns], MANIFEST).coalesce(1).write.mode("overwrite").parquet(path)
    return store.spark.read.parquet(path)


def registered(store: FeatureStore, fs_id: str) -> bool:
    return path_exists(store.spark, f"{store.root}/manifest/{fs_id}/_SUCCESS")
