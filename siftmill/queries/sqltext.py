"""SQL building blocks shared by the checking queries.

They follow the textbook definitions (ranks, cumulative counts, interpolated order statistics)
rather than the way the Spark operators work.
"""

from __future__ import annotations


def auc_cte(src: str, by: str, name: str = "auc_", y: str = "y", p: str = "p") -> str:
    """``name(by, n_pos, n_neg, auc)`` by average ranks."""
    return f"""{name}r AS (SELECT {by}, {y} AS y, rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / CAST(2 AS DOUBLE) AS rnk FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL),
{name} AS (SELECT {by}, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg,
  (sum(rnk) FILTER (WHERE y = 1) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / NULLIF(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0) AS auc FROM {name}r GROUP BY {by})"""


def curve_cte(src: str, by: str, name: str = "curve", y: str = "y", p: str = "p") -> str:
    """One row per group and score: counts at, up to and from the score."""
    return f"""{name}0 AS (SELECT {by}, {p} AS p, CAST(sum({y}) AS DOUBLE) AS pos, CAST(count(*) - sum({y}) AS DOUBLE) AS neg FROM {src} GROUP BY {by}, {p}),
{name} AS (SELECT *, sum(pos) OVER up AS cpos, sum(neg) OVER up AS cneg, sum(pos) OVER down AS tpos, sum(neg) OVER down AS tneg,
  sum(pos) OVER (PARTITION BY {by}) AS pp, sum(neg) OVER (PARTITION BY {by}) AS nn FROM {name}0
  WINDOW up AS (PARTITION BY {by} ORDER BY p), down AS (PARTITION BY {by} ORDER BY p DESC))"""


def edges_cte(src: str, by: str, bins: int, name: str = "edges", v: str = "v") -> str:
    """``name(by, edges)``: distinct interpolated quantiles of the filled values, ascending."""
    return f"""{name}_o AS (SELECT {by}, {v} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {v}) - 1 AS rn, count(*) OVER (PARTITION BY {by}) - 1 AS top FROM {src} WHERE {v} IS NOT NULL),
{name}_q AS (SELECT {by}, i, max(v) FILTER (WHERE rn = floor(top * (CAST(i AS DOUBLE) / {bins}))) AS lo, max(v) FILTER (WHERE rn = ceil(top * (CAST(i AS DOUBLE) / {bins}))) AS hi,
  max(top * (CAST(i AS DOUBLE) / {bins}) - floor(top * (CAST(i AS DOUBLE) / {bins}))) AS t FROM {name}_o, range(0, {bins + 1}) AS g(i) GROUP BY ALL),
{name} AS (SELECT {by}, list_sort(list_distinct(list(lo + (hi - lo) * t))) AS edges FROM {name}_q GROUP BY {by})"""


def right_bin(edges: str, v: str) -> str:
    """Number of interior edges below the value."""
    return f"len(list_filter(list_slice({edges}, 2, len({edges}) - 1), lambda e: e < {v}))"


def left_bin(edges: str, v: str) -> str:
    """Number of interior edges at or below the value."""
    return f"len(list_filter(list_slice({edges}, 2, len({edges}) - 1), lambda e: e <= {v}))"


def long_cte(src: str, features: list[str], name: str = "long", extra: str = "") -> str:
    """``name(feature, v, extra...)`` from the columns of ``src``."""
    more = f", {extra}" if extra else ""
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v{more} FROM {src}" for f in features) + ")"


def psi_cte(src: str, by: str, keep: str, bins: int, name: str = "psi_", v: str = "v", ref: str = "ref") -> str:
    """``name(keep, psi)``; edges per ``by`` from reference rows, bins closed on the left.

    ``keep`` extends ``by`` by the columns that split the compared rows.
    """
    return edges_cte(f"(SELECT * FROM {src} WHERE {ref})", by, bins, f"{name}e", v) + f""",
{name}b AS (SELECT s.*, len(edges) AS k, {left_bin('edges', v)} AS bin FROM {src} s JOIN {name}e USING ({by}) WHERE {v} IS NOT NULL),
{name}r AS (SELECT {by}, bin, greatest(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {by}), 1e-6) AS pe FROM {name}b WHERE {ref} GROUP BY {by}, bin),
{name}a AS (SELECT {keep}, bin, greatest(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {keep}), 1e-6) AS pa FROM {name}b WHERE NOT {ref} GROUP BY {keep}, bin),
{name}g AS (SELECT DISTINCT {keep}, k, UNNEST(range(0, greatest(k - 1, 1))) AS bin FROM (SELECT DISTINCT {keep}, k FROM {name}b WHERE NOT {ref})),
{name} AS (SELECT {keep}, CASE WHEN max(k) < 3 THEN 0 ELSE sum((coalesce(pa, 1e-6) - coalesce(pe, 1e-6)) * ln(coalesce(pa, 1e-6) / coalesce(pe, 1e-6))) END AS psi
  FROM {name}g LEFT JOIN {name}r USING ({by}, bin) LEFT JOIN {name}a USING ({keep}, bin) GROUP BY {keep})"""
