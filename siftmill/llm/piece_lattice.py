"""Encoding and decoding with a SentencePiece BPE model as a relational lattice.

Texts are cut into words where no piece of the model crosses. The substrings of every different
word, bounded by the longest piece, are exploded and joined with the piece table; the edges so
found are grouped by word, and a Viterbi fold over them, a Spark higher-order aggregate, keeps for
every position the last piece of the best way to it.

The model merges pairs by rank, so scores of pieces do not simply add up. What makes a sequence of
pieces the right one is that each neighbouring pair is stable: that no merge across their border
would have come before the merges inside them. The fold therefore scores a transition 0 if it is
stable and minus infinity if not; one edge at each position has a finite score. All merges across a
border are themselves edges of the word's lattice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common
from siftmill.llm.encode import public_path

SPACE = "▁"
NEVER = (1 << 20) - 1
#: Words of the encoded table that one shard holds.
SHARD_WORDS = 1 << 22
#: Bytes of text that a task cuts into words at once; the arrays of a byte take many times its size.
SLICE = 2 << 20


def merge_tree(piece: str, rank: dict[str, int]):
    """The model's merges of one string: nodes left at the end, each (string, rank, left, right)."""
    nodes = [(c, -1, None, None) for c in piece]
    while len(nodes) > 1:
        best = min((rank.get(a[0] + b[0], NEVER), i) for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False)))
        if best[0] == NEVER:
            break
        i = best[1]
        nodes[i : i + 2] = [(nodes[i][0] + nodes[i + 1][0], best[0], nodes[i], nodes[i + 1])]
    return nodes


def spine(node, side: int) -> list[tuple[int, int, int]]:
    """Parts of a piece at its left (2) or right (3) border: length, rank at which the part is made,
    rank at which it goes into the next larger one."""
    out, gone = [], NEVER
    while node is not None:
        out.append((len(node[0]), node[1], gone))
        gone, node = node[1], node[side]
    return out


@lru_cache(maxsize=2)
def _processor(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_path(name))


@lru_cache(maxsize=2)
def pieces(name: str) -> list[tuple]:
    """Pieces that the model can give, with id, rank and spines: as many rows as the model has."""
    sp = _processor(name)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    text = {i: sp.id_to_piece(i) for i in own}
    rank = {text[i]: int(-sp.get_score(i)) for i in own if len(text[i]) > 1}
    out = []
    for i in own:
        nodes = merge_tree(text[i], rank)
        if len(nodes) == 1:
            out.append((text[i], i, nodes[0][1], spine(nodes[0], 2), spine(nodes[0], 3)))
    return out


@lru_cache(maxsize=2)
def _borders(name: str) -> np.ndarray:
    """For each pair of bytes whether a text is cut between them: ASCII pairs inside no piece.

    Before a space, which opens pieces, a text is cut after any byte but a space's own.
    """
    cut = np.zeros((256, 256), bool)
    cut[:128, :128] = True
    for piece, *_ in pieces.__wrapped__(name):  # a worker needs the borders only and keeps no pieces
        raw = piece.replace(SPACE, " ").encode()
        for a, b in zip(raw, raw[1:], strict=False):
            cut[a, b] = False
        if SPACE in piece.lstrip(SPACE):
            raise ValueError("a piece holds a space after another character")
    cut[:, 32] = True
    cut[32, 32] = cut[0x81, 32] = False  # 0x81 may end a literal U+2581, which is a space too
    return cut


def _words(texts: pa.Array, name: str) -> tuple[pa.DictionaryArray | None, np.ndarray]:
    """Words of the texts, with the model's space before each text, and row offsets."""
    flat, offsets = arrays.text_bytes(texts)
    n = np.diff(offsets)
    full = (n > 0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n + full)])
    line = np.full(ends[-1], 32, np.uint8)
    line[np.arange(len(flat)) + np.repeat(np.cumsum(full), n)] = flat
    if not len(line):
        return None, np.zeros(len(n) + 1, np.int64)
    cuts = np.zeros(len(line), bool)
    cuts[1:] = _borders(name)[line[:-1], line[1:]]
    cuts[ends[:-1][full > 0]] = True
    at = np.flatnonzero(cuts)
    return arrays.from_bytes(line, np.append(at, len(line))).dictionary_encode(), np.searchsorted(at, ends)


def distinct_words(rows: DataFrame, name: str) -> DataFrame:
    """Every different word of the ``_text`` column, once; spaces as the model writes them."""
    types = common.schema("word string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                coded, _ = _words(arrays.plain_texts(part.column("_text")), name)
                if coded is not None:
                    yield common.arrow_out({"word": coded.dictionary}, types)

    words = rows.select("_text").mapInArrow(run, types)
    return words.select(F.translate("word", " ", SPACE).alias("word")).distinct()


def _end(edge):
    return F.shiftrightunsigned(edge, 40)


def _start(edge):
    return F.shiftrightunsigned(edge, 16).bitwiseAND(0xFFFFFF)


def _id(edge):
    return edge.bitwiseAND(0xFFFF).cast("int")


def lattice(words: DataFrame, name: str) -> DataFrame:
    """``word`` and its ``edges`` by end and start: substrings that are pieces, and single
    characters that are none. An edge is one number: 24 bits each for its end and start, 16 for
    its id; the id after the last piece's stands for no piece."""
    none = _processor(name).get_piece_size()
    if none >= 1 << 16:
        raise ValueError("the model has more pieces than an edge can name")
    # As many rows as the model has pieces, whatever the input.
    table = words.sparkSession.createDataFrame([(p, i) for p, i, *_ in pieces(name)], "piece string, id long")
    longest = max(len(p) for p, *_ in pieces(name))
    starts = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.length("word"), F.col("start") + longest))).alias("end"))
    spans = spans.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("end") - F.col("start")))
    found = spans.join(F.broadcast(table), "piece", "left").where("id is not null or end = start + 1")
    edge = F.shiftleft(F.col("end").cast("long"), 40) + F.shiftleft(F.col("start").cast("long"), 16) + F.coalesce("id", F.lit(none))
    return found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _merges(name: str):
    """A constant by id: the rank of each piece, and for its left and right border one number for each
    length up to its own (20 bits each for the ranks at which the part of that length is made and
    gone, 0 if the border has none), the first at ``at``."""
    rows = [(0, [], [])] * _processor(name).get_piece_size() + [(NEVER, [(1, -1, NEVER)], [(1, -1, NEVER)])]
    for _, i, *rest in pieces(name):
        rows[i] = rest
    short = lambda rank: min(rank + 1, NEVER)
    # Splits and casts of text are worked out once, by the optimizer; a higher-order function would not be.
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    at = np.cumsum([0, *(max((n for n, *_ in r[1]), default=0) for r in rows)])
    sides = {"at": numbers(at.tolist())}
    for side, k in (("left", 1), ("right", 2)):
        parts = np.zeros(at[-1], np.int64)
        for first, r in zip(at, rows, strict=False):
            for n, made, gone in r[k]:
                parts[first + n - 1] = short(made) << 20 | short(gone)
        sides[side] = numbers(parts.tolist())
    return F.struct(numbers([short(r[0]) for r in rows]).alias("rank"), *[c.alias(n) for n, c in sides.items()])


def _part(merges, side: str, edge, n):
    """The part of length ``n`` at a border of an edge's piece; the piece is at least as long."""
    return F.get(merges[side], (F.get(merges["at"], _id(edge)) + n - 1).cast("int"))


def _made(part):
    return F.shiftrightunsigned(part, 20)


def _gone(part):
    return part.bitwiseAND(0xFFFFF)


def best_path(edges, name: str):
    """The edges of the best way through a word's edges."""
    # Bound to a variable: written out at every use the constant would be held once for each.
    return F.get(F.transform(F.array(_merges(name)), lambda merges: _best_path(edges, merges)), 0)


def _best_path(edges, merges):
    def stable(near, last, e):
        """No edge across the border of ``last`` and ``e`` merges before their own parts do.
        ``near`` are the edges before ``e`` that end after its start."""

        def across(x):
            rank, a, b = F.get(merges["rank"], _id(x)), _part(merges, "right", last, _start(e) - _start(x)), _part(merges, "left", e, _end(x) - _start(e))
            first = (rank < _gone(a)) & (_made(b) < _gone(a)) & (rank <= _gone(b)) & (_made(a) <= _gone(b)) & (_made(a) < _gone(a)) & (_made(b) <= _gone(b))
            return (_start(x) < _start(e)) & (_start(x) >= _start(last)) & (a > 0) & (b > 0) & first

        return ~F.exists(near, across)

    none = lambda of: F.expr(f"cast(array() as array<{of}>)")
    start = F.struct(F.lit(0).alias("seen"), none("int").alias("upto"), none("bigint").alias("best"))

    def fold(kinds):
        """One step for each edge of two characters or more; these alone go across a border. One edge to a
        position is stable: where none of them is, it is that of the single character."""
        merged, single = kinds["merged"], kinds["single"]

        def step(state, e):
            # Edges come by end and start, so those before ``e`` that end after a position follow each other.
            best, seen, upto = state["best"], state["seen"], state["upto"]
            at = (_start(e) - 1).cast("int")
            missing = (_end(e) - 1 - F.size(best)).cast("int")  # below 0: the position has its piece
            first = F.coalesce(F.get(upto, at + 1), seen)
            near = F.slice(merged, first + 1, seen - first)
            good = (missing >= 0) & F.when((at < 0) | (seen == first), True).otherwise(stable(near, F.coalesce(F.get(best, at), F.get(single, at)), e))
            later = (_end(e) - F.size(upto)).cast("int")
            return F.struct(
                (seen + 1).alias("seen"),
                F.when(later > 0, F.concat(upto, F.array_repeat(seen, later))).otherwise(upto).alias("upto"),  # edges that end by each position
                F.when(good, F.concat(best, F.slice(single, F.size(best) + 1, missing), F.array(e))).otherwise(best).alias("best"),
            )

        return F.aggregate(merged, start, step, lambda s: F.concat(s["best"], F.slice(single, F.size(s["best"]) + 1, F.size(single))))

    def walk(path):
        """Edges of the way, from its end to its start and turned round."""
        begin = F.struct(F.size(path).alias("at"), none("bigint").alias("back"))

        def go(state, _):
            here = F.get(path, state["at"] - 1)
            return F.when(state["at"] > 0, F.struct(_start(here).cast("int").alias("at"), F.concat(state["back"], F.array(here)).alias("back"))).otherwise(state)

        return F.aggregate(path, begin, go, lambda s: F.reverse(s["back"]))

    # What is used twice is bound to a variable: written out twice it would be worked out twice.
    kinds = F.array(F.struct(F.filter(edges, lambda e: _end(e) - _start(e) > 1).alias("merged"), F.filter(edges, lambda e: _end(e) - _start(e) == 1).alias("single")))
    return F.get(F.transform(F.transform(kinds, fold), walk), 0)


def encoded_words(words: DataFrame, name: str) -> DataFrame:
    """``word`` and its ``ids``; a character without a piece gives the ids of its bytes."""
    sp = _processor(name)
    folded = lattice(words, name).select("word", best_path(F.col("edges"), name).alias("path"))
    byte_ids = F.array(*[F.lit(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)])
    raw = lambda e: F.encode(F.substring(F.col("word"), _start(e).cast("int") + 1, F.lit(1)), "UTF-8")
    of_bytes = lambda e: F.transform(F.sequence(F.lit(1), F.octet_length(raw(e))), lambda k: F.get(byte_ids, F.conv(F.hex(F.substring(raw(e), k, F.lit(1))), 16, 10).cast("int")))
    ids = F.flatten(F.transform("path", lambda e: F.when(_id(e) < sp.get_piece_size(), F.array(_id(e))).otherwise(of_bytes(e))))
    return folded.select("word", ids.alias("ids"))


def _keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def write_words(table: DataFrame) -> tuple[str, int]:
    """Write the encoded words in shards of bounded size by a hash of the word; folder and shards."""
    types = common.schema("key long, n int, ids binary")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()  # the shard of an earlier run
        for batch in batches:
            words = [w.replace(SPACE, " ").encode() for w in batch.column("word").to_pylist()]
            ids = batch.column("ids")
            ends, flat = arrays.list_offsets(ids), np.asarray(ids.flatten(), np.uint32)
            yield common.arrow_out({"key": _keys(words), "n": np.diff(ends).astype(np.int32), "ids": [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]}, types)

    rows = common.cut_lineage(table.mapInArrow(keyed, types))
    shards = max(1, -(-rows.count() // SHARD_WORDS))
    folder = common.shared_folder(table.sparkSession, "words")
    rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(folder)
    return folder, shards


def _shard(folder: str, i: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, starts, lengths and ids of a shard; a worker keeps the last one it read until
    it reads another one or goes on with other work."""
    name = f"{folder}/shard={i}"
    return common.held(name, lambda: _read_shard(name))


def _read_shard(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(name if ":" in name else f"file://{name}")
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
    table = pq.ParquetDataset(path, filesystem=files, partitioning=None).read()
    keys, n = np.array(table.column("key")), np.array(table.column("n"))
    # From the buffers: an object for each word takes several times what its ids do.
    ids = np.concatenate([np.zeros(0, np.uint8), *[arrays.text_bytes(c.cast(pa.large_binary()))[0] for c in table.column("ids").chunks]]).view(np.uint32)
    del table
    pa.default_memory_pool().release_unused()
    starts = np.cumsum(n, dtype=np.int64) - n
    if (keys[1:] < keys[:-1]).any():  # more than one file
        order = np.argsort(keys)
        keys, starts, n = keys[order], starts[order], n[order]
    return keys, starts, n, ids


def _looked_up(texts: pa.Array, folder: str, shards: int, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts from the encoded table, and row offsets."""
    coded, ends = _words(texts, tokenizer)
    if coded is None:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    keys = _keys(pc.replace_substring(coded.dictionary, SPACE, " ").cast(pa.large_binary()).to_pylist())
    n, parts, starts, base = np.zeros(len(keys), np.int64), [], np.zeros(len(keys), np.int64), 0
    for i in range(shards):
        at = np.flatnonzero(np.mod(keys, shards) == i)
        known, first, length, ids = _shard(folder, i, shards)
        place = np.searchsorted(known, keys[at])
        if len(at) and not (known[np.minimum(place, len(known) - 1)] == keys[at]).all():
            raise ValueError("a word is missing from the encoded table")
        n[at] = length[place]
        starts[at] = base + np.cumsum(n[at]) - n[at]
        parts.append(arrays.ragged_take(ids, first[place], n[at]))
        base += len(parts[-1])
    codes = np.asarray(coded.indices)
    values = arrays.ragged_take(np.concatenate(parts), starts[codes], n[codes])
    return values, np.concatenate([[0], np.cumsum(arrays.segment_sums(n[codes], ends))])


def _table(df: DataFrame, key: str, text: str, tokenizer: str) -> tuple[DataFrame, str, int]:
    """Rows ``_key``, ``_text`` and their encoded words: folder and shards."""
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return rows, *write_words(encoded_words(distinct_words(rows, tokenizer), tokenizer))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """One row for each row of ``df``: key, text, ``ids`` (the model's own ids of the whole text).

    A null or empty text has no ids. Repeated rows and null keys are encoded row by row; other
    columns are ignored; an empty table gives an empty result. Only different words are encoded;
    a task looks its words up in the encoded table shard by shard.
    """
    rows, folder, shards = _table(df, key, text, tokenizer)
    types = common.schema("_key long, _text string, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                values, ends = _looked_up(arrays.plain_texts(part.column("_text")), folder, shards, tokenizer)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))
                yield common.arrow_out({"_key": part.column("_key"), "_text": part.column("_text"), "ids": lists}, types)

    return rows.mapInArrow(run, types).withColumnsRenamed({"_key": key, "_text": text})


@lru_cache(maxsize=2)
def _piece_bytes(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each id as one array with starts and lengths."""
    sp = _processor(name)
    raw = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        raw.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else piece.replace(SPACE, " ").encode())
    n = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n


def decoded(ids: np.ndarray, ends: np.ndarray, name: str) -> list[bytes]:
    """Bytes of the texts whose ids are given; the model's space before each text goes."""
    flat, starts, n = _piece_bytes(name)
    line = arrays.ragged_take(flat, starts[ids], n[ids])
    cut = np.concatenate([[0], np.cumsum(n[ids])])[ends]
    return [line[a:b].tobytes().removeprefix(b" ") for a, b in zip(cut, cut[1:], strict=False)]


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """One row for each row of ``df``: key and ``text``. Null ids give the empty text; bytes that are
    no UTF-8 give U+FFFD."""
    types = common.schema("_key long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_ids")
            texts = decoded(np.asarray(lists.flatten(), np.int64), arrays.list_offsets(lists.fill_null([]) if lists.null_count else lists), tokenizer)
            yield common.arrow_out({"_key": batch.column("_key"), "text": [t.decode("utf-8", "replace") for t in texts]}, types)

    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(ids).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, types).withColumnRenamed("_key", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """Encode and decode again: key, ``n_pieces``, ``ids_crc32`` (unsigned, over little-endian
    unsigned 32-bit ids), ``same`` (the decoded text equals the text)."""
    rows, folder, shards = _table(df, key, text, tokenizer)
    types = common.schema("_key long, n_pieces long, ids_crc32 long, same boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                texts = arrays.plain_texts(part.column("_text"))
                ids, ends = _looked_up(texts, folder, shards, tokenizer)
                back, little = decoded(ids.astype(np.int64), ends, tokenizer), ids.astype("<u4")
                want = texts.cast(pa.large_binary()).to_pylist()
                yield common.arrow_out({"_key": part.column("_key"), "n_pieces": np.diff(ends), "ids_crc32": [zlib.crc32(little[a:b]) for a, b in zip(ends, ends[1:], strict=False)], "same": [a == b for a, b in zip(back, want, strict=True)]}, types)

    # One step: a second one would hold the model and the texts in workers of its own.
    return rows.mapInArrow(run, types).withColumnRenamed("_key", key)
