"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is an n-gram of ``ORDERS`` inside a word, with the spaces beside the word as characters,
and it is present in a text or not. Spark sums, for every n-gram, the toxic and the other texts it
is in; both counts start from the same share, so a rare n-gram has a ratio near one. The log of the
ratio scales the feature, and n-grams without a clear ratio are left out. A regularised logistic
regression over the scaled features gives the score.

Fitted on a bounded sample of labelled rows (``FIT_ROWS`` of each label); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common
from siftmill.llm.quality import code_points
from siftmill.plans.sizing import broadcast_if_small

ORDERS = (4, 5, 6, 7)
#: N-grams are told apart by so many bits.
BITS = 22
#: The model is fitted on at most about so many labelled texts of each label, chosen by hash.
FIT_ROWS = 12_000
#: Texts that every n-gram is credited with, dealt like the labels; the least log ratio; features.
CREDIT, LEAST_RATIO, MOST_FEATURES = 20.0, 1.0, 1 << 16
#: Strength of the quadratic penalty, next to the sum of the losses.
PENALTY = 10.0
#: Bytes of text whose n-grams a task holds at once, and characters hashed at once.
SLICE, BLOCK = 2 << 20, 1 << 18

_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a space before and after each and white space as spaces, and
    the place after each text's last space."""
    points, ends = code_points(texts)
    n = np.diff(ends)
    line = np.full(len(points) + 2 * len(n), 32, np.uint32)
    line[np.arange(len(points)) + np.repeat(np.arange(len(n)), n) * 2 + 1] = points
    line[(line < 128) & _SPACE[np.minimum(line, 127)]] = 32
    return line, ends[1:] + 2 * np.arange(1, len(n) + 1)


def n_grams(line: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of all n-grams, a block of characters at a time. No n-gram has a space but
    at its ends, so none joins two words or two texts."""
    longest = ORDERS[-1]
    for start in range(0, len(line), BLOCK):
        part = line[start : start + BLOCK + longest - 1].astype(np.uint64)
        inner, h = np.ones(len(part), bool), part.copy()
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            if n > 2:
                inner = inner[: len(part) - n + 1] & (part[n - 2 : len(part) - 1] != 32)
            with np.errstate(over="ignore"):
                h = h[: len(part) - n + 1] * np.uint64(0x1F123BB5) + part[n - 1 :]
            if n in ORDERS:
                at = np.flatnonzero(inner[: min(BLOCK, len(part) - n + 1)])
                yield start + at, (arrays.mix64(h[at] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)


def present(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different (text, feature) of the texts. With ``chosen``, a table from hash to feature, only
    features from 0 on count."""
    line, ends = padded(texts)
    found = [np.zeros(0, np.int64)]
    for at, h in n_grams(line):
        if chosen is not None:
            h = chosen[h]
            at, h = at[h >= 0], h[h >= 0].astype(np.int64)
        text = np.searchsorted(ends, at, "right")
        found.append(np.unique((text << BITS) | h))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Weights of the features by hash, and the score of a text without any."""

    hashes: np.ndarray
    weights: np.ndarray
    base: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(texts), 1 / (1 + np.exp(-self.base)))
        text, feature = present(texts, table(self.hashes))
        z = self.base + np.bincount(text, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def table(hashes: np.ndarray) -> np.ndarray:
    """From hash to the number of the feature, -1 for others."""
    out = np.full(1 << BITS, -1, np.int32)
    out[hashes] = np.arange(len(hashes), dtype=np.int32)
    return out


def labelled(df: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``_text``, ``_toxic``: at most about ``FIT_ROWS`` texts of each label, chosen by the hash of the key."""
    told = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("_key")).agg((F.max(label) > 0).alias("_toxic"))
    told = common.cut_lineage(told.where("_key is not null"))
    of = {r["_toxic"]: r["count"] for r in told.groupBy("_toxic").count().collect()}
    share = F.when(F.col("_toxic"), min(1.0, FIT_ROWS / of.get(True, 1))).otherwise(min(1.0, FIT_ROWS / of.get(False, 1)))
    told = told.where(F.pmod(F.xxhash64("_key", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * share)
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    return common.cut_lineage(rows.join(broadcast_if_small(told), "_key").select("_text", "_toxic"))


def ratios(rows: DataFrame, toxic: int, other: int) -> DataFrame:
    """``hash``, ``ratio``: the naive Bayes log-count ratio of each n-gram with a clear one."""
    types = common.schema("hash int, toxic long, other long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                text, h = present(arrays.plain_texts(part.column("_text")))
                mark = np.asarray(part.column("_toxic").to_numpy(zero_copy_only=False), bool)[text]
                hashes, at = np.unique(h, return_inverse=True)
                of = [np.bincount(at.ravel()[side], minlength=len(hashes)) for side in (mark, ~mark)]
                yield common.arrow_out({"hash": hashes.astype(np.int32), "toxic": of[0], "other": of[1]}, types)

    counts = rows.mapInArrow(count, types).groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    part = toxic / (toxic + other)
    ratio = F.log((F.col("toxic") + CREDIT * part) / toxic) - F.log((F.col("other") + CREDIT * (1 - part)) / other)
    return counts.where("toxic + other >= 2").select("hash", ratio.alias("ratio")).where(F.abs("ratio") >= LEAST_RATIO)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model of the labelled rows. A key with several labels is toxic if one says so; null labels,
    null keys and null texts do not count. With one label only every score is that label's, and
    without any it is 0."""
    rows = labelled(df, labels, key, text, label)
    of = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    toxic, other = of.get(True, 0), of.get(False, 0)
    if not toxic or not other:
        return Model(np.zeros(0, np.int64), np.zeros(0), 500.0 if toxic else -500.0)
    clear = ratios(rows, toxic, other).orderBy(F.abs("ratio").desc(), "hash").limit(MOST_FEATURES).collect()
    if not clear:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(toxic / other)))
    hashes, ratio = np.array([r["hash"] for r in clear], np.int64), np.array([r["ratio"] for r in clear])
    types = common.schema("label double, at array<int>")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = table(hashes)
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                who, feature = present(arrays.plain_texts(part.column("_text")), chosen)
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=part.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield common.arrow_out({"label": part.column("_toxic").cast(pa.int8()).cast(pa.float64()), "at": lists}, types)

    # A row has at most MOST_FEATURES numbers and there are about 2 * FIT_ROWS rows.
    vector = F.udf(lambda at: Vectors.sparse(len(ratio), at, ratio[at]), VectorUDT())
    points = common.cut_lineage(rows.mapInArrow(scaled, types)).select("label", vector("at").alias("features"))
    fitted = LogisticRegression(maxIter=60, regParam=PENALTY / (toxic + other), standardization=False).fit(points)
    return Model(hashes, fitted.coefficients.toArray() * ratio, float(fitted.intercept))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.3, held_out: Column | None = None) -> DataFrame:
    """One row for each row of ``df``: key, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from
    ``least`` on).

    Only the text is judged, and all of it. A null or empty text has the score of a text without
    any known feature; repeated rows and null keys are judged row by row; other columns are
    ignored; an empty table gives an empty result.
    """
    types = common.schema("_key long, held_out boolean, score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                s = model.scores(arrays.plain_texts(part.column("_text")))
                yield common.arrow_out({"_key": part.column("_key"), "held_out": part.column("held_out"), "score": s, "predicted": (s >= least).astype(np.int32)}, types)

    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("_key"), held.alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, types).withColumnRenamed("_key", key)
