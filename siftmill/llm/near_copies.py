"""Near copies by SetSketch registers, banding, a likelihood estimate and an exact check.

A sketch holds for each register the floor of the logarithm, to a base a little over 1, of the
smallest exponential hash of the set: exponentially spaced truncated minima. The register-wise
maximum of two sketches is the sketch of the union. Two registers agree with a probability near
the similarity of the sets, so bands of registers find candidates.

Texts of equal shingle sets are one class first. In a bucket of a band every class meets the
smallest one, which joins a large group of copies without all pairs; classes that the links so
found leave in different components are then compared within their buckets, each first with the
few most alike; groups where that leaves pairs out are compared again with more, at last with all
that are still apart. A bit map of each set bounds
from above what two sets can share, so that the many pairs of a large group that lie a little below
the threshold are not made at all. Whatever is left is confirmed on the full sets of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm import arrays, common
from siftmill.plans.sizing import broadcast_if_small

REGISTERS, BAND = 160, 5
BASE, RATE = 1.07, 20.0
#: A candidate is checked unless its estimated similarity lies this far below the threshold,
#: six standard errors of an estimate from all registers.
SLACK = 0.2
#: Members of a bucket that one task compares; a larger bucket is cut into pairs of such parts.
PART = 2048
#: Most alike partners of a class that each round after the first checks; the last round checks all.
ROUNDS = (2, 16, None)
#: Bytes of text that a task cuts into shingles at once; the arrays of a byte take many times its size.
SLICE = 2 << 20
#: Bits of a set's map for each shingle at least, and the most bytes of a map: above 8,192 shingles
#: the map gets denser and its bound looser, but stays a bound.
MAP_BITS, MOST_MAP = 8, 8192
_SHIFT = np.uint64(32)


def _multipliers(n: int) -> np.ndarray:
    return arrays.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, with repeats, and row offsets.

    A text of fewer words is one shingle, a text without words has none.
    """
    found, ends = arrays.words(texts)
    hashes, n = arrays.word_hashes(found), np.diff(ends)
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = np.arange(offsets[-1]) + np.repeat(ends[:-1] - offsets[:-1], sizes)
    length = np.repeat(np.minimum(n, width), sizes)
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64)
        for k in range(width):
            here = k < length
            at = np.minimum(first + k, max(len(hashes) - 1, 0))
            out = np.where(here, arrays.mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at]), out) if len(hashes) else out
    return out, offsets


def registers(hashes: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Sketch of each set as one uint8 row; an empty set has zeros."""
    out = np.zeros((len(offsets) - 1, m), np.uint8)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    starts, least = offsets[:-1][full], np.empty((m, len(full)), np.uint32)
    multipliers = _multipliers(m)
    step = 1 << 15  # so many hashes stay in the processor's cache
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + step, "right")) - 1)
        part = hashes[starts[a] : starts[b] if b < len(full) else len(hashes)]
        cut, buffer, small = starts[a:b] - starts[a], np.empty_like(part), np.empty(len(part), np.uint32)
        with np.errstate(over="ignore"):
            for i in range(m):
                np.multiply(part, multipliers[i], out=buffer)
                np.right_shift(buffer, _SHIFT, out=small, casting="unsafe")
                np.minimum.reduceat(small, cut, out=least[i, a:b])
        a = b
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 255).astype(np.uint8)
    return out


def likelihood_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Similarity of pairs of sketches (rows of ``a`` and ``b``) that makes their registers most
    likely, given the sizes of the sets: one joint likelihood of the registers above, below and
    equal, on a grid of ``steps`` similarities."""
    chance = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    out = np.zeros(len(a))
    for lo in range(0, len(a), 1024):  # the grid of a few pairs at a time
        part = slice(lo, lo + 1024)
        above, below = (a[part] > b[part]).sum(1)[:, None], (a[part] < b[part]).sum(1)[:, None]
        equal = a.shape[1] - above - below
        u = (n_a[part] / (n_a[part] + n_b[part]))[:, None]
        v = 1 - u
        j = np.minimum(u, v) / np.maximum(u, v) * np.linspace(0, 1, steps)[None, :]
        more, less = chance(u - v * j), chance(v - u * j)
        told = above * np.log(more) + below * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-12))
        out[part] = j[np.arange(len(j)), told.argmax(1)]
    return out


def bit_map(hashes: np.ndarray) -> bytes:
    """One bit for each hash of a set, at its lowest digits; a power of two of bytes, so the halves
    of a longer map laid on each other are the shorter one."""
    width = 8
    while width < MOST_MAP and 8 * width < MAP_BITS * len(hashes):
        width *= 2
    out = np.zeros(8 * width, bool)
    out[(hashes & np.uint64(8 * width - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


class Maps:
    """The bit maps of a table's rows, by length."""

    def __init__(self, maps: list[bytes]):
        self.maps, self.width, self.held = maps, np.array([len(m) for m in maps], np.int64), {}

    def _of(self, width: int, at: np.ndarray) -> np.ndarray:
        """Maps of the rows ``at``, none shorter than ``width``, laid together to it."""
        if width not in self.held:
            place, found = np.zeros(len(self.maps), np.int64), []
            for w in np.unique(self.width[self.width >= width]):
                rows = np.flatnonzero(self.width == w)
                place[rows] = np.arange(len(rows)) + sum(map(len, found))
                whole = np.frombuffer(b"".join(self.maps[r] for r in rows), np.uint8).reshape(len(rows), -1, width)
                found.append(np.bitwise_or.reduce(whole, 1).view(np.uint64))
            self.held[width] = place, np.concatenate(found)
        place, table = self.held[width]
        return table[place[at]]

    def may_reach(self, i: np.ndarray, j: np.ndarray, n_i: np.ndarray, n_j: np.ndarray, percent: float) -> np.ndarray:
        """Whether the sets of rows ``i`` and ``j`` can be similar enough: a bit that only one of two
        maps has stands for at least one shingle that only that set has."""
        out, width = np.zeros(len(i), bool), np.minimum(self.width[i], self.width[j])
        for w in np.unique(width):
            of, step = np.flatnonzero(width == w), max(1, (2 << 20) // int(w))
            for part in (of[k : k + step] for k in range(0, len(of), step)):
                a, b = self._of(int(w), i[part]), self._of(int(w), j[part])
                only_a, only_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a & ~b, b & ~a))
                shared = np.minimum(n_i[part] - only_a, n_j[part] - only_b)
                out[part] = 100 * shared >= (1 - 1e-9) * percent * (n_i[part] + n_j[part] - shared)
        return out


_SKETCHED = "_key long, n_shingles long, set_hash binary, sketch binary, bits binary"


def _sketched(batch: pa.RecordBatch, width: int, types: T.StructType) -> Iterator[pa.RecordBatch]:
    """The rows of ``sketches`` for a batch, a slice of its text at a time."""
    import xxhash

    for part in arrays.slices(batch, "_text", SLICE):
        hashes, ends = shingles(arrays.plain_texts(part.column("_text")), width)
        sets = [np.unique(hashes[ends[i] : ends[i + 1]]) for i in range(part.num_rows)]
        found = registers(hashes, ends)
        yield common.arrow_out({"_key": part.column("_key"), "n_shingles": [len(s) for s in sets], "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "sketch": [r.tobytes() for r in found], "bits": [bit_map(s) for s in sets]}, types)


def sketches(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per row: ``_key``, ``n_shingles``, ``set_hash`` (128 bits of the sorted set), ``sketch``, ``bits``."""
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    types = common.schema(_SKETCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            yield from _sketched(batch, width, types)

    return rows.mapInArrow(run, types)


def _banded(classes: DataFrame) -> DataFrame:
    """One row for each class and band: ``bucket``, ``band``, ``rep``, ``n``."""
    types = common.schema("bucket long, band int, rep long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _matrix(batch.column("sketch"))
            bands = table.shape[1] // BAND
            with np.errstate(over="ignore"):
                keys = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(table), 0)
                for k in range(BAND):
                    keys = keys * np.uint64(256) + table[:, k::BAND][:, :bands]
            ids, n = (np.repeat(np.asarray(batch.column(c)), bands) for c in ("rep", "n"))
            yield common.arrow_out({"bucket": arrays.mix64(keys.ravel()).astype(np.int64), "band": np.tile(np.arange(bands, dtype=np.int32), len(table)), "rep": ids, "n": n}, types)

    return classes.select("rep", "n", "sketch").mapInArrow(run, types)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _likely(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose estimated similarity ``alike`` reaches ``floor``."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    types = common.schema("a long, b long, alike double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                n_a, n_b = (np.asarray(part.column(c), np.float64) for c in ("n_a", "n_b"))
                alike = likelihood_estimate(_matrix(part.column("s_a")), _matrix(part.column("s_b")), n_a, n_b)
                good = pa.array(alike >= floor)
                yield common.arrow_out({c: part.column(c).filter(good) for c in ("a", "b")} | {"alike": pa.array(alike).filter(good)}, types)

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, types)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    needed = common.cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct())
    texts = texts.join(broadcast_if_small(needed), "_key", "left_semi")
    side = lambda x: texts.select(F.col("_key").alias(x), F.col("_text").alias(f"t_{x}"))
    types = common.schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "t_a", SLICE):
                (h_a, e_a), (h_b, e_b) = (shingles(arrays.plain_texts(part.column(c)), width) for c in ("t_a", "t_b"))
                good = []
                for i in range(part.num_rows):
                    x, y = np.unique(h_a[e_a[i] : e_a[i + 1]]), np.unique(h_b[e_b[i] : e_b[i + 1]])
                    common_n = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common_n > 0 and 100 * common_n >= percent * (len(x) + len(y) - common_n))
                yield common.arrow_out({c: part.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")}, types)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(run, types)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its smallest reachable node, for every node of ``edges`` (a, b).

    Large-star and small-star steps in turn until every edge ends at a root. A node with very many
    edges is answered by a join that the adaptive planner splits, and each step is a written table.
    """
    links = common.cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select("b", "a"))
        least = common.cut_lineage(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("a"), F.min("b")).alias("m")))
        wide = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        wide = common.cut_lineage(wide)
        least = common.cut_lineage(wide.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        joined = wide.join(least, wide.a == least.u)
        links = common.cut_lineage(joined.select("a", F.col("m").alias("b")).union(joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        child = links.select(F.col("a").alias("node")).distinct()
        unsettled = links.join(child, links.b == child.node, "left_semi").limit(1).count() or links.count() != child.count()
        if not unsettled:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _rooted(frame: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    found = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return frame.join(found, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def _groups(members: DataFrame, classes: DataFrame, roots: DataFrame, ratio: float) -> DataFrame:
    """Rows of the buckets that still hold different components, dealt to comparable groups.

    ``members`` has ``bucket``, ``band``, ``rep``, ``n``. Sizes are cut into classes of
    ``1 / ratio``, so a similar pair lies in one class or in neighbours. A group above ``PART``
    members is dealt to parts, and every pair of parts is a group of its own. Members of its
    largest component, which need no comparison with each other, have parts of their own, and no
    group holds two of these: one part of others makes one more row of each member, not one for
    every part of the group.
    """
    rooted = _rooted(members, roots, "rep", "root")
    split = common.cut_lineage(rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_members")).where("low != high and n_members > 2").select("bucket"))
    rows = rooted.join(split, "bucket").withColumn("size_class", F.floor(F.log("n") / -np.log(ratio)).cast("int"))
    rows = rows.withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = common.cut_lineage(rows.withColumn("size_class", F.col("size_class") + F.col("guest").cast("int")))
    group = ["bucket", "size_class"]
    sizes = rows.groupBy(*group, "root").agg(F.count("*").alias("n_root"), F.min("guest").alias("no_own"))
    sizes = sizes.groupBy(*group).agg(F.sum("n_root").alias("n_all"), F.max(F.struct("n_root", "root")).alias("most"), F.count("*").alias("n_roots"), F.min("no_own").alias("no_own")).where("n_roots > 1 and not no_own")
    parts = lambda n: F.when(F.col("n_all") > PART, F.ceil(n / PART)).otherwise(0).cast("int")
    sizes = common.cut_lineage(sizes.select(*group, F.col("most.root").alias("largest"), parts(F.col("n_all") - F.col("most.n_root")).alias("few"), parts(F.col("most.n_root")).alias("many")))
    rows = rows.join(sizes, group)
    large, in_largest = F.col("few") > 0, F.col("root") == F.col("largest")
    place = F.pmod(F.xxhash64("rep"), F.greatest(F.when(in_largest, F.col("many")).otherwise(F.col("few")), F.lit(1))).cast("int")
    rows = rows.withColumn("part", F.when(large & in_largest, F.col("few") + place).otherwise(place))
    others = F.when(in_largest, F.col("few")).otherwise(F.col("few") + F.col("many"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(large, others).otherwise(1) - 1)))
    rows = rows.select(*group, "band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "rep", "root", "n", "guest")
    return rows.join(classes.select("rep", "sketch", "bits"), "rep")


#: What a group of rows that are compared with each other has in common.
BY = ["bucket", "size_class", "p", "q"]
#: Pairs that a task looks at together, and ranked pairs that it holds before it drops the lower ones.
PORTION, HELD = 1 << 15, 1 << 18


def _alike(rows: dict[str, np.ndarray], floor: float, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Likely pairs of rows of equal ``group`` (rows are sorted by it) and their estimates, a portion
    at a time, so the memory does not grow with the square of a group.

    Rows of a group with two parts (``cross``) pair only with the other part. Rows of one component
    do not pair, and a pair counts in the first band that its classes share and nowhere else. Pairs
    whose bit maps (``maps``) rule out a similarity of ``ratio`` go, whatever their estimate.
    """
    group, guest, n, part, cross, root, band, sketch = (rows[c] for c in ("group", "guest", "n", "part", "cross", "root", "band", "sketch"))
    later = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1
    total, bands = np.cumsum(later), sketch.shape[1] // BAND
    at = 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PORTION, "right")))
        i = np.repeat(np.arange(at, stop), later[at:stop])
        first = np.cumsum(later[at:stop]) - later[at:stop]
        j = i + 1 + np.arange(len(i)) - np.repeat(first, later[at:stop])
        good = ~(guest[i] & guest[j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])) & ((part[i] != part[j]) | ~cross[i]) & (root[i] != root[j])
        i, j = i[good], j[good]
        same = sketch[i] == sketch[j]
        # A cheap bound before the likelihood.
        good = same.sum(1) >= (floor - 0.1) * sketch.shape[1]
        good &= same[:, : bands * BAND].reshape(len(i), bands, BAND).all(2).argmax(1) == band[i]
        i, j = i[good], j[good]
        if "maps" in rows:
            good = rows["maps"].may_reach(i, j, n[i], n[j], 100 * ratio)
            i, j = i[good], j[good]
        if len(i):
            alike = likelihood_estimate(sketch[i], sketch[j], n[i], n[j])
            good = alike >= floor
            yield i[good], j[good], alike[good]
        at = stop


def _closest(i: np.ndarray, j: np.ndarray, alike: np.ndarray, rep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` most alike ``j`` of each ``i``; ties to the smaller key."""
    order = np.lexsort((rep[j], -alike, i))
    i, j, alike = i[order], j[order], alike[order]
    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(np.diff(i, prepend=-1) != 0, np.arange(len(i)), 0))
    return i[rank < most], j[rank < most], alike[rank < most]


def _chosen(rows: dict[str, np.ndarray], floor: float, ratio: float, most: int | None, cut: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of likely pairs in portions; with ``most`` only those that rank high for one of the two.

    ``cut`` takes True for rows with more likely partners than ``most``.
    """
    rep, held, size = rows["rep"], [], 0

    def closest():
        i, j, alike = (np.concatenate(x) for x in zip(*held, strict=True))
        kept = _closest(i, j, alike, rep, most)
        if cut is not None:
            cut[np.bincount(i, minlength=len(rep)) > np.bincount(kept[0], minlength=len(rep))] = True
        return kept

    for i, j, alike in _alike(rows, floor, ratio):
        if most is None:
            yield np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])
            continue
        held.append((np.concatenate([i, j]), np.concatenate([j, i]), np.tile(alike, 2)))
        size += 2 * len(i)
        if size > HELD:
            held = [closest()]
            size = 0
    if held:
        i, j, _ = closest()
        yield np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])


def _compared(groups: DataFrame, floor: float, ratio: float, most: int | None) -> DataFrame:
    """Likely pairs ``a``, ``b`` of different components in each group.

    A class gives its ``most`` most alike partners (all for None). A group where that leaves pairs
    out gives one row more, its ``BY`` without ``a`` and ``b``; all others are done.
    """
    types = common.schema("a long, b long, bucket long, size_class int, p int, q int")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {c: np.asarray(table.column(c)) for c in ("rep", "root", "part", "guest", "band")}
        rows["n"], rows["sketch"] = np.asarray(table.column("n")).astype(np.float64), _matrix(table.column("sketch").combine_chunks())
        rows["maps"] = Maps(table.column("bits").to_pylist())
        rows["group"], rows["cross"] = np.cumsum(_new_group(table, BY)), np.asarray(table.column("p")) != np.asarray(table.column("q"))
        cut = np.zeros(len(rows["rep"]), bool)
        for a, b in _chosen(rows, floor, ratio, most, cut):
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            yield common.arrow_out({"a": pairs[:, 0], "b": pairs[:, 1]} | dict.fromkeys(BY, pa.nulls(len(pairs))), types)
        open_groups = table.take(np.searchsorted(rows["group"], np.unique(rows["group"][cut]))).combine_chunks()
        yield common.arrow_out(dict.fromkeys("ab", pa.nulls(open_groups.num_rows)) | {c: pa.array(np.asarray(open_groups.column(c))) for c in BY}, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = np.flatnonzero(_new_group(held, BY))[-1] if held.num_rows else 0
            if last and held.num_rows >= 4096:  # the last group may go on
                yield from compare(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from compare(held)

    dealt = groups.repartition(*BY).sortWithinPartitions(*BY)
    return dealt.mapInArrow(run, types).distinct()


def _again(groups: DataFrame, still: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the groups ``still``, with the components of by now."""
    return _rooted(groups.join(broadcast_if_small(still), BY, "left_semi").drop("root"), roots, "rep", "root")


def _new_group(table: pa.Table, by: list[str]) -> np.ndarray:
    """Whether each row starts another group than the row before."""
    changed = np.zeros(table.num_rows, bool)
    for c in by:
        changed |= np.diff(np.asarray(table.column(c)), prepend=0) != 0
    changed[:1] = True
    return changed


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``df``: key, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets;
    ``component_id`` is the smallest key reachable. A null or empty text, or one without words, has
    0 shingles and is linked with nothing. Rows of one key are one document: their texts share
    a component. A row without a key is linked with nothing, has no component and is kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    ratio, floor = percent / 100, percent / 100 - SLACK
    rows = common.cut_lineage(sketches(df, key, text, width))
    some = rows.where("n_shingles > 0 and _key is not null")
    reps = some.groupBy("set_hash").agg(F.min("_key").alias("rep"))
    reps = common.cut_lineage(reps)
    own = some.select("set_hash", F.col("_key").alias("rep"), F.col("n_shingles").alias("n"), "sketch", "bits")
    classes = common.cut_lineage(own.join(reps, ["set_hash", "rep"]).dropDuplicates(["set_hash", "rep"]))
    banded = _banded(classes)
    leaders = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("n_leader"), F.count("*").alias("n_members")).where("n_members > 1")
    leaders = common.cut_lineage(leaders)
    members = common.cut_lineage(banded.join(leaders, "bucket"))
    texts = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    fits = F.least("n", "n_leader") >= ratio * F.greatest("n", "n_leader")
    pairs = members.where((F.col("rep") != F.col("leader")) & fits).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    likely = common.cut_lineage(_likely(pairs, classes, floor))
    twice = some.groupBy("_key").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low != high").select("_key")
    keyed = common.cut_lineage(some.select("_key", "set_hash").join(twice, "_key").join(reps, "set_hash").select(F.col("_key").alias("a"), F.col("rep").alias("b")))
    links = keyed.union(_confirmed(likely.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b")), texts, width, percent))
    links = common.cut_lineage(links)
    roots = common.cut_lineage(components(links))
    apart = _rooted(_rooted(likely, roots, "a", "root_a"), roots, "b", "root_b").where("root_a != root_b").select("a", "b")
    groups = still = None
    for most in (0, *ROUNDS):
        if most != 0:
            if groups is None:
                groups = _groups(members.select("bucket", "band", "rep", "n"), classes, roots, ratio)
            elif still.isEmpty():  # every likely pair has been confirmed or refused
                break
            else:
                groups = _again(groups, still, roots)
            groups = common.cut_lineage(groups)
            found = common.cut_lineage(_compared(groups, floor, ratio, most))
            apart, still = found.where("a is not null").select("a", "b"), found.where("a is null").select(*BY)
        apart = common.cut_lineage(apart)
        if apart.isEmpty():
            continue
        links = common.cut_lineage(links.union(_confirmed(apart, texts, width, percent)))
        roots = common.cut_lineage(components(links))

    of_class = common.cut_lineage(_rooted(reps, roots, "rep", "root").select("set_hash", "root"))
    out = rows.select("_key", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    linked = (F.col("n_shingles") > 0) & F.col("_key").isNotNull()
    out = out.withColumn("component_id", F.when(linked, F.col("root")).otherwise(F.col("_key")))
    return out.select(F.col("_key").alias(key), "n_shingles", "component_id", (F.col("_key").isNull() | (F.col("_key") == F.col("component_id"))).alias("kept"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``df`` without the documents that are near copies of one with a smaller key."""
    return common.without(df, key, near_copies(df, key, text, width, percent).where("not kept").select(key))
