"""Document fingerprints as similarity digests of improbable features.

A feature is a window of ``WINDOW`` bytes. Its entropy is counted over all windows of all
documents; the rarer an entropy, the more improbable the feature. Among every ``SPAN`` windows in a
row the rarest (leftmost of equals) scores, and windows that score often enough are selected, or
those that score most in a text where none does: every text but the empty one has a feature. Their
hashes go into a chain of Bloom filters, each of ``BITS`` bits and at most ``FULL`` features, and
two digests are as alike as their filters' bits overlap beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common
from siftmill.llm.quality import code_points

WINDOW, SPAN, OFTEN = 64, 64, 16
BITS, FULL, HASHES = 2048, 160, 5
LEVELS = 1000  # entropies are whole numbers from 0 to LEVELS
_TERM = np.array([0] + [round(LEVELS * 4096 * c / WINDOW * np.log2(WINDOW / c) / np.log2(WINDOW)) for c in range(1, WINDOW + 1)], np.int64)


def entropies(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy level of each window inside one text, the place of its first byte, and row offsets.

    A text shorter than a window has none. The entropy changes from window to window by the byte
    that leaves and the one that enters, whose counts come from comparing the bytes with themselves
    shifted; sums are whole numbers, so equal texts have equal levels wherever they stand.
    """
    n = np.diff(offsets)
    number = np.maximum(n - WINDOW + 1, 0)
    ends = np.concatenate([[0], np.cumsum(number)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], number)
    if not len(at):
        return np.zeros(0, np.int64), at, ends
    before, after = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.uint8)
    for k in range(1, WINDOW):
        same = (flat[k:] == flat[:-k]).view(np.uint8)
        before[k:] += same  # equal bytes among the WINDOW - 1 before
        after[:-k] += same
    # Step from the window at i to that at i + 1.
    step = _TERM[after[at]] - _TERM[after[at] + 1]
    enter = np.minimum(at + WINDOW, len(flat) - 1)
    step += _TERM[before[enter] + 1] - _TERM[before[enter]]
    first = ends[:-1][number > 0]
    rows = np.flatnonzero(number > 0)
    counts = np.zeros(len(rows) * 256, np.int64)
    head = (offsets[:-1][rows][:, None] + np.arange(WINDOW)[None, :])
    np.add.at(counts, (np.arange(len(rows))[:, None] * 256 + flat[head]).ravel(), 1)
    start = _TERM[counts.reshape(-1, 256)].sum(1)
    total = np.concatenate([[0], np.cumsum(step[:-1])])
    level = total + np.repeat(start - total[first], number[rows])
    return np.clip(level >> 12, 0, LEVELS), at, ends


def popularity(level: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Number of spans of its text in which each window is the rarest.

    A text with fewer windows than a span has one span of all of them, whose rarest has ``OFTEN``.
    """
    if not len(level):
        return np.zeros(0, np.int64)
    value = (rank[level] << 40) + np.arange(len(level))
    least, width = value.copy(), 1
    while width < SPAN:  # minimum of the next 2, 4, 8 ... windows
        step = min(width, SPAN - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    n = np.diff(ends)
    spans = np.maximum(n - SPAN + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(spans)])
    at = np.arange(offsets[-1]) + np.repeat(ends[:-1] - offsets[:-1], spans)
    score = np.bincount(least[at] & ((1 << 40) - 1), minlength=len(level))
    short = np.flatnonzero((n > 0) & (n < SPAN))
    if len(short):
        parts = [slice(ends[i], ends[i + 1]) for i in short]
        score[[p.start + int(value[p].argmin()) for p in parts]] = OFTEN
    return score


def selected(level: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indexes of the windows that are the rarest of ``OFTEN`` or more spans of their text."""
    return np.flatnonzero(popularity(level, ends, rank) >= OFTEN)


def features(level: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """As ``selected``, but a text none of whose windows is selected has its most popular ones: it
    has fewer than ``OFTEN`` spans, or its rarest windows recur so soon that they share the spans."""
    score = popularity(level, ends, rank)
    n = np.diff(ends)
    if not len(score):
        return score
    most = np.maximum.reduceat(score, ends[:-1][n > 0])
    return np.flatnonzero(score >= np.repeat(np.minimum(most, OFTEN), n[n > 0]))


def feature_hashes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of each window that starts at ``at``."""
    out = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for lo in range(0, len(at), 1 << 16):
        here = at[lo : lo + (1 << 16)]
        words = flat[here[:, None] + np.arange(WINDOW)].view("<u8")
        for k in range(words.shape[1]):
            with np.errstate(over="ignore"):
                out[lo : lo + len(here)] = arrays.mix64(out[lo : lo + len(here)] * np.uint64(3) + words[:, k])
    return out


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters as rows of bytes; features in text order, each different one once."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    filters = max(1, -(-len(hashes) // FULL))
    bits = np.zeros((filters, BITS), np.uint8)
    row = np.arange(len(hashes)) // FULL
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def whole_digest(flat: np.ndarray) -> np.ndarray:
    """Chain of a text shorter than a window: one feature, the whole text; none for no text."""
    if not len(flat):
        return chain(np.zeros(0, np.uint64))
    return chain(np.array([int.from_bytes(hashlib.sha256(flat.tobytes()).digest()[:8], "little")], np.uint64))


def digests(texts: pa.Array, rank: np.ndarray) -> list[np.ndarray]:
    """Chain of filters of each text."""
    flat, offsets = arrays.text_bytes(texts)
    level, at, ends = entropies(flat, offsets)
    chosen = features(level, ends, rank)
    hashes = feature_hashes(flat, at[chosen])
    cut = np.searchsorted(chosen, ends)
    return [chain(hashes[cut[i] : cut[i + 1]]) if ends[i + 1] > ends[i] else whole_digest(flat[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]


_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best normalised bit overlap, averaged by bits.

    The overlap of two filters is the share of common bits beyond those expected by chance, of the
    most that the emptier filter allows. Chains without a feature are alike only to each other.
    """
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    set_a, set_b = _POP[a].sum(1), _POP[b].sum(1)
    if not set_a.sum() or not set_b.sum():
        return float(set_a.sum() == set_b.sum())
    if a.shape == b.shape and (a == b).all():
        return 1.0
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = _POP[a[i] & b].sum(1)
        chance, most = set_a[i] * set_b / BITS, np.minimum(set_a[i], set_b)
        best[i] = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()
    return float((best * set_a).sum() / set_a.sum())


def as_text(filters: np.ndarray) -> str:
    """A fingerprint as a string: the filters in base 64."""
    return base64.b64encode(filters.tobytes()).decode("ascii")


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def rarity(df: DataFrame, text: str) -> np.ndarray:
    """Rank of each entropy level, the rarest over all windows of all texts first; unseen levels
    are the rarest. One row per level reaches the driver."""
    types = common.schema("level int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in arrays.slices(batch, "_text", arrays.SLICE_BYTES // 3):
                level, _, _ = entropies(*arrays.text_bytes(arrays.plain_texts(part.column("_text"))))
                total += np.bincount(level, minlength=LEVELS + 1)
        yield common.arrow_out({"level": np.arange(LEVELS + 1, dtype=np.int32), "n": total}, types)

    seen = df.select(F.col(text).alias("_text")).mapInArrow(count, types).groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in seen:
        counts[r["level"]] = r["n"]
    rank = np.empty(LEVELS + 1, np.int64)
    rank[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return rank


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in key order inside blocks, with ``first`` marking a copy of the row that follows a block.

    Block edges are key values; only they, one per block, reach the driver. The document after the
    last is the first.
    """
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    n = common.blocks(rows)
    edges = rows.select("_key").where("_key is not null").approxQuantile("_key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    edges = sorted({int(e) for e in edges})
    known, at = F.col("_key").isNotNull(), F.coalesce("_key", F.lit(-(2**63)))
    rows = rows.withColumn("_block", _block(at, edges, 0, len(edges)))
    order = F.struct(known.alias("known"), at.alias("at"), F.col("_tie").alias("tie"))
    firsts = sorted((r["_block"], *r["first"]) for r in rows.select("_block", order.alias("first")).groupBy("_block").agg(F.min("first").alias("first")).collect())
    if not firsts:
        return rows.withColumn("_first", F.lit(False))
    # One row per block, MOST_BLOCKS at most: its first row, and the block before (of the first the last).
    table = df.sparkSession.createDataFrame([(b, firsts[i - 1][0], *rest) for i, (b, *rest) in enumerate(firsts)], "_block int, _before int, _known boolean, _at long, _first_tie long")
    rows = rows.join(F.broadcast(table), "_block")
    is_first = (known == F.col("_known")) & (at == F.col("_at")) & (F.col("_tie") == F.col("_first_tie"))
    own, copy = (F.struct(F.col(c).alias("b"), F.lit(c != "_block").alias("f")) for c in ("_block", "_before"))
    rows = rows.withColumn("_to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select(F.col("_to.b").alias("_block"), F.col("_to.f").alias("_first"), "_key", "_text", "_tie")
    return rows.repartitionByRange(len(firsts), "_block").sortWithinPartitions("_block", "_first", F.col("_key").asc_nulls_first(), "_tie")


def _block(at, edges: list[int], low: int, high: int):
    """Number of edges not above a key, as a search tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(at < edges[middle], _block(at, edges, low, middle)).otherwise(_block(at, edges, middle + 1, high))


def edited(texts: list[str], following: list[str]) -> list[str]:
    """Each text with its second half replaced by the beginning of the next text."""
    return [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is that of the next larger key, after the last the first; equal keys follow
    each other by a hash of their texts and null keys come first. A null text is empty; an empty
    text has a fingerprint without features, a text shorter than a window one feature. A single
    document is its own next one. Other columns are ignored; an empty table gives an empty result.
    """
    rank = rarity(df, text)
    rows = with_next(df, key, text)
    types = common.schema("_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def rows_of(keys: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        changed = edited(texts, following)
        every = digests(pa.array([*texts, *following[-1:]], pa.large_string()), rank)
        own, ahead = every[: len(texts)], every[1:]
        of_changed = digests(pa.array(changed, pa.large_string()), rank)
        return common.arrow_out({
            "_key": keys, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in changed],
            "fingerprint": [as_text(f) for f in own], "edited_fingerprint": [as_text(f) for f in of_changed],
            "near_edited": [likeness(a, b) for a, b in zip(own, of_changed, strict=True)], "near_next": [likeness(a, b) for a, b in zip(own, ahead, strict=True)],
        }, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held, block = [], [], None  # the last row waits for the one after it
        for batch in batches:
            for part in arrays.slices(batch, "_text", arrays.SLICE_BYTES // 6):
                texts = arrays.plain_texts(part.column("_text")).to_pylist()
                for b, first, k, t in zip(part.column("_block").to_pylist(), part.column("_first").to_pylist(), part.column("_key").to_pylist(), texts, strict=True):
                    if b != block:
                        held_keys, held, block = [], [], b
                    if first:  # the block is over; a repeated first row follows itself
                        if held:
                            yield rows_of(held_keys, held, held[1:] + [t])
                        held_keys, held = [], []
                    else:
                        held_keys.append(k)
                        held.append(t)
                if len(held) > 1:
                    yield rows_of(held_keys[:-1], held[:-1], held[1:])
                    held_keys, held = held_keys[-1:], held[-1:]

    return rows.select("_block", "_first", "_key", "_text").mapInArrow(run, types).withColumnRenamed("_key", key)
