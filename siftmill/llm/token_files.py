"""Token-id files: equal-length sequences and masks in Arrow stream files.

A shard is an Arrow stream of record batches with two fixed-size-list columns, ``ids`` and
``mask``. All batches but the last hold the same number of sequences and so take the same number
of bytes, and only the last sequence of a shard is padded: the place of any token follows from
where the first batch starts and how long a batch is. A reader maps the file and takes a batch
without reading or copying the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm import arrays, common, encode

SEQUENCE = 1024
BATCH_SEQUENCES = 256
_INDEX = "_key long, shard int, path string, at long, n_tokens long, first_batch long, batch_bytes long"


def _folder(address: str):
    """File system and path of a shared folder, for the tasks' own files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


class ShardWriter:
    """Writes one shard; tokens come in any portions. The file appears under its name only when whole."""

    def __init__(self, folder: str, name: str, attempt: str, length: int = SEQUENCE, wide: bool = False):
        self.fs, base = _folder(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.draft = f"{base}/{name}.arrows", f"{base}/.{name}-{attempt}"
        self.length, self.type = length, pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.draft)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.rest = np.zeros(0, self.type.to_pandas_dtype())
        self.tokens, self.batch_at = 0, []

    def _batch(self, ids: np.ndarray, filled: int) -> None:
        # The schema is written together with the first batch.
        self.batch_at.append(self.out.tell() or self.schema.serialize().size)
        mask = np.zeros(len(ids), bool)
        mask[:filled] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        size = self.length * BATCH_SEQUENCES
        self.tokens += len(ids)
        ids = np.concatenate([self.rest, ids.astype(self.rest.dtype)])
        whole = len(ids) // size * size
        for i in range(0, whole, size):
            self._batch(ids[i : i + size], size)
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            rows = -(-len(self.rest) // self.length)
            self._batch(np.concatenate([self.rest, np.zeros(rows * self.length - len(self.rest), self.rest.dtype)]), len(self.rest))
        self.writer.close()
        self.out.close()
        self.first_batch = self.batch_at[0] if self.batch_at else 0
        self.batch_bytes = self.batch_at[1] - self.batch_at[0] if len(self.batch_at) > 1 else 0
        if any(b - a != self.batch_bytes for a, b in zip(self.batch_at, self.batch_at[1:], strict=False)):
            raise ValueError("batches of one shard differ in length")
        self.fs.move(self.draft, self.path)  # the same name and bytes whichever attempt comes last


class ShardReader:
    """Random access to a shard: a batch is taken from the mapped file without a copy."""

    def __init__(self, folder: str, path: str, first_batch: int, batch_bytes: int):
        from pyarrow import fs

        files, _ = _folder(folder)
        if isinstance(files, fs.LocalFileSystem):
            self.buffer = pa.memory_map(path).read_buffer()
        else:  # a store without maps: one read of the shard
            with files.open_input_file(path) as f:
                self.buffer = f.read_buffer()
        self.first_batch, self.batch_bytes = first_batch, batch_bytes
        self.schema = pa.ipc.open_stream(self.buffer).schema
        self.length = self.schema.field("ids").type.list_size

    def batch(self, i: int) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.buffer.slice(self.first_batch + i * self.batch_bytes)), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        row, batch = i % BATCH_SEQUENCES, self.batch(i // BATCH_SEQUENCES)
        ids, mask = (batch.column(c).values.slice(row * self.length, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def tokens(self, at: int, n: int) -> np.ndarray:
        """Tokens ``at`` to ``at + n`` of the shard, across sequences and batches."""
        size, parts = self.length * BATCH_SEQUENCES, []
        while n > 0:
            values = self.batch(at // size).column("ids").values.to_numpy(zero_copy_only=True)
            parts.append(values[at % size : at % size + n])
            at, n = at + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint16)])


def write_token_files(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, length: int = SEQUENCE, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text and write the shards in ascending key order.

    Returns the folder and the index: key, ``shard``, ``path``, ``at`` (the document's place in
    its shard), ``n_tokens`` (with the end id), ``first_batch`` and
    ``batch_bytes``. Rows of equal keys are documents
    of their own, ordered by a hash of their texts; null keys come first; a null text is empty and
    gives the end id alone. Other columns are ignored; an empty table gives an empty index.
    The shards of a lost executor are written again under the same names with the same bytes.
    """
    spark = df.sparkSession
    folder = folder or common.shared_folder(spark, "token-files")
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    rows = common.in_order(rows, "_key", common.blocks(rows), F.xxhash64("_text"))
    types = common.schema(_INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, writer, coder = task.partitionId(), None, encode.encoder(tokenizer)
        keys, places, sizes = [], [], []
        for batch in batches:
            for part in arrays.slices(batch, "_text"):
                writer = writer or ShardWriter(folder, f"shard-{shard:06d}", f"{task.taskAttemptId()}", length)
                ids, ends = coder.ids(arrays.plain_texts(part.column("_text")))
                n = part.num_rows
                with_end = np.full(len(ids) + n, end_id, np.uint32)
                spot = np.ones(len(with_end), bool)
                spot[ends[1:] + np.arange(n)] = False
                with_end[spot] = ids
                keys.append(part.column("_key"))
                places.append(writer.tokens + ends[:-1] + np.arange(n))
                sizes.append(np.diff(ends) + 1)
                writer.add(with_end)
        if writer:
            writer.close()
            keys, places, sizes = pa.chunked_array(keys).combine_chunks(), np.concatenate(places), np.concatenate(sizes)
            for i in range(0, len(keys), 10_000):
                k = len(keys[i : i + 10_000])
                whole = {"shard": shard, "path": writer.path, "first_batch": writer.first_batch, "batch_bytes": writer.batch_bytes}
                yield common.arrow_out({"_key": keys[i : i + k], "at": places[i : i + k], "n_tokens": sizes[i : i + k]} | {c: [v] * k for c, v in whole.items()}, types)

    index = f"{folder}/index"
    rows.mapInArrow(write, types).write.parquet(index)
    return folder, spark.read.schema(types).parquet(index).withColumnRenamed("_key", key)


def read_token_files(spark: SparkSession, folder: str, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document from the files: key, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` (unsigned, over little-endian unsigned 32-bit ids), ``shard``."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # one row a shard, MOST_BLOCKS at most
    before = F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("_before"))
    types = common.schema("_key long, shard int, at long, n_tokens long, ids_crc32 long")
    rows = index.select(F.col(key).alias("_key"), *[c for c in index.columns if c != key])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for batch in batches:
            paths, at, n, first, step = (batch.column(c).to_pylist() for c in ("path", "at", "n_tokens", "first_batch", "batch_bytes"))
            crc = []
            for i, path in enumerate(paths):
                if path != opened:
                    opened, reader = path, ShardReader(folder, path, first[i], step[i])
                crc.append(zlib.crc32(reader.tokens(at[i], n[i]).astype("<u4")))
            yield common.arrow_out({"_key": batch.column("_key"), "shard": batch.column("shard"), "at": at, "n_tokens": n, "ids_crc32": crc}, types)

    found = rows.mapInArrow(digest, types).join(F.broadcast(starts), "shard")
    return found.select(F.col("_key").alias(key), (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
