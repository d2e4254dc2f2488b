"""Token counts: how many ids a public tokenizer gives for each whole text.

Arrow functions encode batches balanced by bytes and return lengths only; long texts are cut
where the tokenizer's result cannot change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common, encode


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """One row for each row of ``df``: key, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    No begin, end or other special token is added; nothing is truncated. A null or empty text
    has 0 bytes and 0 tokens. Repeated rows and keys are counted row by row; a null key stays.
    Other columns of ``df`` are ignored. An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = common.schema("_key long, n_bytes long, n_tokens long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encode.encoder(tokenizer, False)
        for batch in batches:
            for part in arrays.slices(batch, "_text"):
                texts = arrays.plain_texts(part.column("_text"))
                yield common.arrow_out({"_key": part.column("_key"), "n_bytes": np.asarray(pc.binary_length(texts), np.int64), "n_tokens": counter.counts(texts)}, out)

    return rows.mapInArrow(count, out).select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
