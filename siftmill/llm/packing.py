"""Best-fit packing of whole documents into sequences of one length.

The plan depends on the number of pieces of each length only. Lengths above a third of the
capacity go at most two to a bin and are matched greedily, the largest with the largest that
fits; shorter ones then fill the tightest gaps, longest first. As the counts are one row per
length, the plan is made once on the driver whatever the number of documents, and gives
intervals of bins for intervals of ranks. Each piece finds its place from its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common, encode

CAPACITY = 1024
#: Bytes of text that a task encodes at once.
SLICE = 3 << 20
_PIECES = "_key long, _row long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length as rows
    ``(length, first rank, ranks, first bin, offset, pieces a bin)``.

    The number of rows is bounded by the capacity, not by the counts.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    taken: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free length -> intervals of bins
    bins = 0

    def put(size: int, first_bin: int, n_bins: int, offset: int, each: int) -> None:
        n = n_bins * each
        rows.append((size, taken[size], n, first_bin, offset, each))
        taken[size] += n
        left[size] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        for b in (b for b in large if b <= a and a + b <= capacity):
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                put(a, bins, n, 0, 1)
                put(b, bins, n, a, 1)
                gaps.setdefault(capacity - a - b, []).append((bins, n))
                bins += n
        if n := left[a]:
            put(a, bins, n, 0, 1)
            gaps.setdefault(capacity - a, []).append((bins, n))
            bins += n

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                each = min(capacity // s, left[s])
                n = left[s] // each
                first, gap = bins, capacity
                bins += n
            else:
                first, n_free = gaps[gap].pop()
                each = min(gap // s, left[s])
                n = min(n_free, left[s] // each)
                if n < n_free:
                    gaps[gap].append((first + n, n_free - n))
                if not gaps[gap]:
                    del gaps[gap]
            put(s, first, n, capacity - gap, each)
            if gap - each * s:
                gaps.setdefault(gap - each * s, []).append((first, n))
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pieces(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; of a longer one the first piece is shorter."""
    types = common.schema(_PIECES)
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # The next task of the worker needs the same words again; other work drops them first.
        coder = common.held(f"packing {tokenizer}", lambda: encode.Encoder(encode.public_path(tokenizer)))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                ids, ends = coder.ids(arrays.plain_texts(part.column("_text")))
                n = np.diff(ends) + 1
                number = -(-n // capacity)
                doc = np.repeat(np.arange(part.num_rows), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                first = n - (number - 1) * capacity
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                little = ids.astype("<u4")
                end = np.array([end_id], "<u4").tobytes()
                at, last = (ends[:-1][doc] + start).tolist(), (piece == number[doc] - 1).tolist()
                crc = [zlib.crc32(end, zlib.crc32(little[a : a + k - 1])) if z else zlib.crc32(little[a : a + k]) for a, k, z in zip(at, length.tolist(), last, strict=True)]
                yield common.arrow_out({"_key": part.column("_key").take(pa.array(doc)), "_row": row + doc, "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}, types)
                row += part.num_rows

    return rows.mapInArrow(cut, types)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    One row per piece: key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. A null text is empty and gives one piece with the end id alone. Rows of equal keys
    are documents of their own. Other columns are ignored; an empty table gives an empty result.
    """
    cut = common.cut_lineage(pieces(df, key, text, tokenizer, end_id, capacity))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # one row per length, capacity at most
    places = plan(counts, capacity)
    types = common.schema(f"{_PIECES}, sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = (places[:, 0] << 44) + places[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = places[np.searchsorted(order, (length << 44) + rank, "right") - 1]
            over = rank - row[:, 1]
            each = row[:, 5]
            yield common.arrow_out({c: batch.column(c) for c in types.names[:6]} | {"sequence_id": row[:, 3] + over // each, "offset": row[:, 4] + over % each * length}, types)

    placed = common.salted_rank(cut, "length", ["_key", "_row", "piece"]).mapInArrow(place, types)
    return placed.select(F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
