"""Encoding whole texts with the public tokenizers inside Arrow batches.

A byte-level BPE splits a text into pretokens and encodes each by itself, and a piece model whose
pieces hold no space after another character never joins two words. Texts are therefore cut into
chunks where that provably changes nothing, every different chunk of a batch is encoded once by
the library, and the chunks seen first are kept for later batches. Texts with literal special
strings go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftmill.llm import arrays

#: Words that a worker keeps between batches; further ones are encoded again in each batch.
KEPT_WORDS = 3 << 18
#: A batch handed to a library call holds about so many bytes.
BATCH_BYTES = 1 << 20


def public_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def by_bytes(texts: list[str], limit: int = BATCH_BYTES):
    """Consecutive lists of about ``limit`` bytes; one text at least."""
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x) + 16
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Words:
    """Encoded words as one ragged array; the first ``KEPT_WORDS`` different words stay."""

    def __init__(self, encode: Callable[[list[str]], list], keep_ids: bool):
        self.encode, self.keep_ids = encode, keep_ids
        self.place: dict[str, int] = {}
        self.values, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def table(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word its row, and the table of rows: values, starts, lengths."""
        get = self.place.get
        at = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        new = np.flatnonzero(at < 0)
        fresh = [found[i] for i in new]
        parts, sizes = [], []
        for part in by_bytes(fresh):
            for ids in self.encode(part):
                if self.keep_ids:
                    parts.extend(ids)
                    sizes.append(len(ids))
                else:
                    sizes.append(len(ids))
        at[new] = len(self.lengths) + np.arange(len(new))
        values = np.concatenate([self.values, np.array(parts, np.uint32)])
        lengths = np.concatenate([self.lengths, np.array(sizes, np.int64)])
        room = KEPT_WORDS - len(self.place)
        if room > 0 and fresh:
            for w in fresh[:room]:
                self.place[w] = len(self.place)
            n = len(self.place)
            self.lengths, self.values = lengths[:n].copy(), values[: lengths[:n].sum() if self.keep_ids else 0].copy()
        return at, values, np.cumsum(lengths) - lengths, lengths


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


_ALNUM = _class((48, 57), (65, 90), (97, 122))
_INK = _class((33, 126))  # ASCII other than white space and controls
_MARK = _INK & ~_ALNUM
_NOT_SPACE = _INK | _class((0xC3, 0xC3))  # 0xC3 opens U+00C0 to U+00FF, none of which is white space


def _byte_level_cuts(flat: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the byte-level pretokenizer always starts a pretoken, whatever follows the chunk.

    Before a space unless white space may stand on both sides of it, between an ASCII letter or
    digit and an ASCII mark, before a line feed after ink, and after a lone line feed. ``last``
    holds the last byte of each text: nothing of the next text may decide.
    """
    before, after = np.roll(flat, 1), np.roll(flat, -1)
    after[last] = 32
    cuts = (flat == 32) & (_INK[before] | _NOT_SPACE[after])
    cuts |= _ALNUM[before] & _MARK[flat]
    feed = flat == 10
    cuts |= feed & _INK[before]
    alone = feed & _INK[before]
    cuts[1:] |= alone[:-1] & _INK[flat[1:]]
    return cuts


def _piece_cuts(flat: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Before single spaces; 0x81 and 0xE2 may belong to a literal U+2581, which is a space too."""
    before, after = np.roll(flat, 1), np.roll(flat, -1)
    after[last] = 33
    return (flat == 32) & (before != 32) & (before != 0x81) & (after != 32) & (after != 0xE2)


class Encoder:
    """``ids(texts)`` gives all ids and row offsets; ``counts(texts)`` only the number per row."""

    def __init__(self, path: str, keep_ids: bool = True):
        self.pieces = path.endswith(".model")
        (self._open_pieces if self.pieces else self._open_json)(path)
        self.table = _Words(self._chunks, keep_ids)

    def _open_json(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        tok = Tokenizer.from_file(path)
        split = said.get("pre_tokenizer") or {}
        # Cutting is only known to be safe for the plain byte-level scheme.
        self.separable = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not said.get("normalizer")
        self.whole_if = [t.content for t in tok.get_added_tokens_decoder().values()]
        self._encode = self._chunks = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.cuts = _byte_level_cuts

    def _open_pieces(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces) and sp.encode("a  b ", out_type=str)[-1] == "▁" and sp.encode("a b") == sp.encode("a") + sp.encode("b")
        self.whole_if = []
        self._encode = lambda texts: sp.encode(texts, num_threads=1)
        # The library sets a space before each text: it stands for the one a chunk starts with.
        # A chunk of a space alone closes a text.
        space = sp.encode("a ")[-1:]
        self._chunks = lambda texts: [ids if x != " " else space for x, ids in zip(texts, sp.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1), strict=True)]
        self.cuts = _piece_cuts

    def _split(self, texts: pa.Array):
        """Which texts are cut, their chunks as a dictionary array, and chunk offsets per text."""
        plain = np.full(len(texts), self.separable)
        for special in self.whole_if if self.separable else ():
            plain &= ~np.asarray(pc.match_substring(texts, special), dtype=bool)
        if self.pieces and self.separable:
            plain &= ~np.asarray(pc.starts_with(texts, " "), dtype=bool)
        flat, offsets = arrays.text_bytes(texts.filter(pa.array(plain)) if not plain.all() else texts)
        if not len(flat):
            return plain, None, np.zeros(int(plain.sum()) + 1, np.int64)
        starts = offsets[:-1][np.diff(offsets) > 0]
        cuts = self.cuts(flat, offsets[1:][np.diff(offsets) > 0] - 1)
        cuts[starts] = True
        at = np.flatnonzero(cuts)
        chunks = arrays.from_bytes(flat, np.append(at, len(flat)))
        return plain, chunks.dictionary_encode(), np.searchsorted(at, offsets)

    def _rows(self, chunks: pa.DictionaryArray):
        rows, values, starts, lengths = self.table.table(chunks.dictionary.to_pylist())
        return rows[np.asarray(chunks.indices)], values, starts, lengths

    def _whole(self, texts: pa.Array, rows: np.ndarray) -> list[list[int]]:
        return [ids for part in by_bytes(texts.take(pa.array(rows)).to_pylist()) for ids in self._encode(part)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Ids per text."""
        plain, chunks, offsets = self._split(texts)
        out = np.zeros(len(texts), np.int64)
        if chunks is not None:
            rows, _, _, lengths = self._rows(chunks)
            out[plain] = arrays.segment_sums(lengths[rows], offsets)
        rest = np.flatnonzero(~plain)
        out[rest] = [len(x) for x in self._whole(texts, rest)]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts as uint32, and the offsets of the texts."""
        plain, chunks, offsets = self._split(texts)
        sizes, values = np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        if chunks is not None:
            rows, table, starts, lengths = self._rows(chunks)
            taken = lengths[rows]
            sizes[plain] = arrays.segment_sums(taken, offsets)
            values = arrays.ragged_take(table, starts[rows], taken)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return values, np.concatenate([[0], np.cumsum(sizes)])
        whole = self._whole(texts, rest)
        sizes[rest] = [len(x) for x in whole]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(ends[-1], np.uint32)
        mine = np.repeat(plain, sizes)
        out[mine] = values
        out[~mine] = np.concatenate([np.array(x, np.uint32) for x in whole])
        return out, ends


@lru_cache(maxsize=4)
def encoder(name: str, keep_ids: bool = True) -> Encoder:
    """One encoder for each model and worker process."""
    return Encoder(public_path(name), keep_ids)
