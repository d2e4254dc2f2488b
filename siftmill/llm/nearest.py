"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector is cut into segments, coarse to fine. For one segment of length w with means a, b and
deviations s, t, the squared distance of two vectors is at least ``w * ((a - b)**2 + (s - t)**2)``.
As ``x . q = (|x|^2 + |q|^2 - d^2) / 2``, a lower bound of the distance is an upper bound of the
score. Queries and candidates meet in blocks. A block first scores a few promising candidates
exactly, which gives each query a score that its k best reach; then candidates whose bound lies
below it drop out level by level, and the survivors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm import common

#: Candidates and queries of a block; a task holds one block of each and their bounds.
CANDIDATES, QUERIES = 16_384, 1_024
#: Segments of a vector at each level; a level with more segments than components is left out.
LEVELS = (1, 4, 16)
#: Candidates that a block scores first, by their coarse bound, for each query's first threshold.
SEEDS = 64


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of scaled means and deviations per segment: squared differences of these rows add up
    to the lower bound of the squared distance."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    means = np.stack([x[:, a:b].mean(1) for a, b in zip(edges, edges[1:], strict=False)], 1)
    spread = np.stack([x[:, a:b].std(1) for a, b in zip(edges, edges[1:], strict=False)], 1)
    return np.concatenate([means, spread], 1) * np.sqrt(np.tile(np.diff(edges), 2))


def block_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query, id, score)`` of each query's k best rows of a block, ties to the smaller id.

    Components are whole numbers whose products stay exact in double precision.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    x, q = rows.astype(np.float64), queries.astype(np.float64)
    norm_x, norm_q = (x * x).sum(1), (q * q).sum(1)
    levels = [n for n in LEVELS if n <= x.shape[1]] or [1]
    stats = [(statistics(x, n), statistics(q, n)) for n in levels]

    def bound(level: int, i: int, at: np.ndarray) -> np.ndarray:
        of_x, of_q = stats[level]
        gap = of_x[at] - of_q[i]
        return (norm_x[at] + norm_q[i] - np.einsum("ij,ij->i", gap, gap)) / 2

    out = []
    slack = 1e-9 * (norm_x.max(initial=0) + norm_q.max(initial=0)) + 1e-6  # for rounding in the bounds
    for i in range(len(q)):
        other = np.flatnonzero(ids != query_ids[i])
        coarse = bound(0, i, other)
        seeds = other[np.argpartition(-coarse, SEEDS)[:SEEDS]] if len(other) > SEEDS else other
        first = x[seeds] @ q[i]
        least = np.partition(first, -k)[-k] if len(first) > k else -np.inf
        left = other[coarse >= least - slack]
        for level in range(1, len(levels)):
            left = left[bound(level, i, left) >= least - slack]
        score = x[left] @ q[i]
        best = np.lexsort((ids[left], -score))[:k]
        out += [(int(query_ids[i]), int(ids[left[b]]), int(score[b])) for b in best]
    return out


def vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``_key``, ``dim`` and ``v`` (floor(scale * x) as 64-bit bytes) of the usable rows."""
    types = common.schema("_key long, dim int, v binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            n = np.asarray(lists.value_lengths().fill_null(-1))
            flat = lists.flatten()
            values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
            ends = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero((n > 0) & (bad[ends[1:]] == bad[ends[:-1]]))
            with np.errstate(invalid="ignore"):
                whole = np.floor(scale * values)
            v = [whole[ends[i] : ends[i + 1]].tobytes() for i in good]
            yield common.arrow_out({"_key": batch.column("_key").take(pa.array(good)), "dim": n[good].astype(np.int32), "v": v}, types)

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("_v")).mapInArrow(run, types)


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Per query (keys divisible by ``every``) its ``k`` rows of highest score: ``query_id``,
    ``rank``, ``key``, ``score`` (integer inner product), ties to the smaller key.

    A row is compared with all rows of other keys and of the same number of components. Null keys,
    null or empty vectors and those with null or non-finite components take no part. Repeated rows
    of a key are candidates of their own; a key asked twice is answered once, by its first vector in
    byte order. With fewer than ``k`` candidates all are returned. An empty table gives an empty
    result.
    """
    rows = common.cut_lineage(vectors(df, key, vector, scale))
    blocks = {r["dim"]: max(1, -(-r["count"] // CANDIDATES)) for r in rows.groupBy("dim").count().collect()}  # one row per vector length
    if not blocks:
        blocks = {0: 1}
    parts = F.create_map(*[x for dim, n in blocks.items() for x in (F.lit(dim), F.lit(n))])
    placed = rows.withColumn("part", F.pmod(F.xxhash64("_key"), parts[F.col("dim")]).cast("int"))
    asked = rows.where(F.col("_key") % every == 0).groupBy("_key", "dim").agg(F.min("v").alias("v"))
    asked = asked.groupBy("_key").agg(F.min_by(F.struct("dim", "v"), F.struct("dim", "v")).alias("first")).select("_key", "first.*")
    asked = asked.withColumn("group", F.pmod(F.xxhash64("_key", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.lit(CANDIDATES / QUERIES / every) * parts[F.col("dim")]).cast("int"))).cast("int"))
    # Each block of queries meets each block of candidates of the same length.
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("dim")] - 1)))
    groups = asked.select("dim", "part", "group").distinct()
    both = placed.join(common.cut_lineage(groups), ["dim", "part"]).select("dim", "part", "group", "_key", "v", F.lit(False).alias("asks"))
    both = both.union(asked.select("dim", "part", "group", "_key", "v", F.lit(True).alias("asks")))

    def search(table: pa.Table) -> pa.Table:
        keys, asks = np.asarray(table.column("_key")), np.asarray(table.column("asks"))
        matrix = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(keys), -1)
        found = block_top(matrix[asks], keys[asks], matrix[~asks], keys[~asks], k)
        return pa.table({c: pa.array([r[i] for r in found], pa.int64()) for i, c in enumerate(("query_id", "_id", "score"))})

    best = both.groupBy("dim", "part", "group").applyInArrow(search, common.schema("query_id long, _id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(key), "score")
