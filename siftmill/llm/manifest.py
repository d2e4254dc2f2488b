"""Merkle manifest of a dataset by slot pivots, in DataFrame operations alone.

Every row is a leaf. The leaves of a group, in the order of their key, are numbered by running
totals over literal ranges of the key. Conditional aggregates spread the children of a parent into
``FANOUT`` columns: their concatenation is hashed for the parent, and leaving out one's own column
gives one's siblings. The roots of the groups form one more tree in the same way.

Proofs are made from the top down. A parent's row, which already holds its children, meets the
siblings found above it and hands them on, so a leaf never joins one table for each level; the
texts are hashed in the first pass and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import common
from siftmill.plans.ordered import plan_buckets, running_totals
from siftmill.plans.sizing import broadcast_if_small

FANOUT = 8
#: Input bytes whose leaves are numbered together, and group roots that are.
LEAF_BLOCK_BYTES, ROOTS_BLOCK = 2 << 20, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts; null parts add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_rows(df: DataFrame, fields: Sequence[str], key: str, group: str, text: str, tampered: Column) -> DataFrame:
    """``g``, ``key``, ``h`` (the leaf) and ``told`` (the leaf as found, where ``tampered``).

    ``g`` orders like the group and is never null: empty for a null group, else ``=`` and its value.
    """
    folded = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in fields]
    return df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).alias("key"),
        digest(*[field(F.col(c)) for c in fields]).alias("h"),
        F.when(F.coalesce(tampered, F.lit(False)), digest(*[field(c) for c in folded])).alias("told"),
    )


def numbered(rows: DataFrame, by: list[str], order: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``i`` (place from 0 in the group) and ``n`` (size of the group)."""
    one = F.lit(1).cast("long")
    out = running_totals(rows, by, order, {"i": one}, plan_buckets(rows, order[0], buckets), grand={"n": one})
    return out.withColumn("i", F.col("i") - 1)


def nodes_left(level: int) -> Column:
    """Nodes of a group of ``n`` leaves at a level: each is 1 / ``FANOUT`` of the level below, rounded up."""
    width = FANOUT**level
    return F.expr(f"(n + {width - 1}L) div {width}L")


def grow(nodes: DataFrame, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Pivoted parents of every level from the bottom, and the root of each group (``g``, ``h``).

    ``nodes`` has ``g``, ``n``, ``i``, ``h`` and the ``payload``, which stays in the lowest slots.
    """
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    levels, tops = [], nodes.where("n = 1").select("g", "h")
    while FANOUT ** len(levels) < most:
        level = len(levels)
        slot = F.col("i") % FANOUT
        child = F.struct("h", *(payload if not level else ()))
        pivot = [F.max(F.when(slot == s, child)).alias(f"c{s}") for s in range(FANOUT)]
        parents = nodes.where(nodes_left(level) > 1).groupBy("g", "n", F.expr(f"i div {FANOUT}L").alias("i")).agg(*pivot)
        levels.append(common.cut_lineage(parents))
        nodes = levels[-1].select("g", "n", "i", digest(*[F.col(f"c{s}.h") for s in range(FANOUT)]).alias("h"))
        tops = tops.unionByName(nodes.where(nodes_left(level + 1) == 1).select("g", "h"))
    return levels, tops


def descend(levels: list[DataFrame], above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Leaves of the trees of two and more: ``g``, ``i``, the child struct ``c`` and ``path``, the
    siblings ``l`` (left) and ``r`` (right) of every level up to the root over all groups.

    ``above`` has the ``path`` of each group's root and columns to be ``carried`` along.
    """
    paths = None
    for level in range(len(levels) - 1, -1, -1):
        top = nodes_left(level + 1) == 1
        met = levels[level].where(top).join(broadcast_if_small(above), "g")
        if paths is not None:
            met = met.unionByName(levels[level].where(~top).join(paths.drop("c"), ["g", "i"]))
        hashes = [F.col(f"c{s}.h") for s in range(FANOUT)]
        slots = [F.struct(F.lit(s).alias("s"), F.col(f"c{s}").alias("c"), F.concat_ws("", *hashes[:s]).alias("l"), F.concat_ws("", *hashes[s + 1 :]).alias("r")) for s in range(FANOUT)]
        spread = met.select("g", "i", "path", *carried, F.explode(F.array(*slots)).alias("x")).where("x.c is not null")
        paths = spread.select("g", (F.col("i") * FANOUT + F.col("x.s")).alias("i"), "x.c", F.concat(F.array(F.struct("x.l", "x.r")), "path").alias("path"), *carried)
    return paths


def manifest(df: DataFrame, key: str = "doc_id", group: str = "lang", text: str = "text", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None) -> DataFrame:
    """One row for each row of ``df``: key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root``, ``verified``, ``n_siblings``.

    ``tampered`` marks rows whose ``text`` is found with A-Z in lower case; their leaf as found is
    folded with the original siblings. Nulls in any field are hashed as such; a null key is first in
    its group and a null group the first group. Rows of one key follow their leaf, so repeated rows
    are leaves side by side. An empty or very long text is hashed whole. Other columns are ignored;
    an empty table gives an empty result.
    """
    mark = F.lit(False) if tampered is None else tampered
    leaves = common.cut_lineage(leaf_rows(df, fields, key, group, text, mark))
    placed = common.cut_lineage(numbered(leaves, ["g"], ["key", "h"], common.blocks(df, LEAF_BLOCK_BYTES)))
    levels, tops = grow(placed, ("key", "told"))
    roots = common.cut_lineage(tops)
    ordered = common.cut_lineage(numbered(roots, [], ["g"], -(-roots.count() // ROOTS_BLOCK)).select(F.lit("").alias("g"), "n", "i", "h", F.col("g").alias("of")))
    upper, top = grow(ordered, ("of",))
    root = top.first()
    empty = F.array().cast("array<struct<l:string,r:string>>")
    above = ordered.where("n = 1").select(F.col("of").alias("g"), empty.alias("path"), F.col("h").alias("subroot"))
    if upper:
        start = ordered.sparkSession.range(1).select(F.lit("").alias("g"), empty.alias("path"))
        above = descend(upper, start).select(F.col("c.of").alias("g"), "path", F.col("c.h").alias("subroot"))
    above = common.cut_lineage(above)
    alone = placed.where("n = 1").join(broadcast_if_small(above), "g").select("key", "h", "told", "path", "subroot")
    rows = alone
    if levels:
        rows = alone.unionByName(descend(levels, above, ("subroot",)).select("c.key", "c.h", "c.told", "path", "subroot"))
    told = F.coalesce("told", "h")
    folded = F.aggregate("path", told, lambda acc, p: F.sha2(F.concat(p["l"], acc, p["r"]), 256))
    return rows.select(
        F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"),
        F.sha2(F.aggregate("path", F.lit(""), lambda acc, p: F.concat(acc, p["l"], p["r"])), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        F.aggregate("path", F.lit(0), lambda acc, p: acc + F.length(p["l"]) + F.length(p["r"]), lambda x: (x / 64).cast("int")).alias("n_siblings"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
