"""Token counts, token files and packing next to the libraries' own answers."""

import zlib

import numpy as np
import pytest

from siftmill.llm import common, packing, token_counts, token_files
from siftmill.llm.encode import public_path

ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\nb", "a \nb", "a\n b", "a \n b", "a \n  b", "\n\n x\t", "\nE", "q\n\nA", "z  ",
    "<|endoftext|>", "a <|endoftext|> b", "a\n <|endoftext|>", "x　 　y", "x    y", "é é", "à é", "a▁b", "▁", "don't I'm 'll", "a'b'll",
    "9,9", "é—,a", "\x1c \x1d a", "🙂 🙂🙂", "<s> </s>", "aaa" * 3000, "word, " * 30_000, "  run " * 500, "中文" * 800,
]


def bpe(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(public_path("byte_bpe_50k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(frame):
    return frame([(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a"), (3, "a")])


def test_counts(docs):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    want = {"piece_bpe_32k.model": lambda t: len(pieces.encode(t)), "byte_bpe_50k.json": lambda t: len(bpe([t])[0])}
    texts = {i * 3: t or "" for i, t in enumerate(ODD)}
    for name, count in want.items():
        rows = token_counts.token_counts(docs, tokenizer=name, limit=100).collect()
        assert len(rows) == len(ODD) + 3
        for r in rows:
            if r.doc_id is not None and r.doc_id != 3:
                t = texts[r.doc_id]
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 100), t[:20]


def test_files_round_trip(spark, docs):
    folder, index = token_files.write_token_files(docs, length=64)
    rows = token_files.read_token_files(spark, folder, index).collect()
    rows.sort(key=lambda r: r.start)
    assert len(rows) == len(ODD) + 3 and rows[0].doc_id is None and rows[0].start == 0
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    want = dict(zip((i * 3 for i in range(len(ODD))), bpe(ODD), strict=True))
    for r in rows[1:]:
        if r.doc_id != 3:
            assert (r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]) + 1, crc(want[r.doc_id] + [2]))


def test_sequences_are_views_with_masks(docs):
    _, index = token_files.write_token_files(docs, length=64)
    shards = index.groupBy("shard", "path", "first_batch", "batch_bytes").agg({"n_tokens": "sum"}).collect()
    for s in shards:
        reader = token_files.ShardReader("/", s.path, s.first_batch, s.batch_bytes)
        n = s["sum(n_tokens)"]
        last = (n - 1) // 64
        ids, mask = reader.sequence(last)
        assert len(ids) == len(mask) == 64 and mask.sum() == n - last * 64 and not ids[~mask].any()
        assert not reader.sequence(0)[0].flags.owndata
        assert (np.concatenate([reader.sequence(i)[0] for i in range(last + 1)])[:n] == reader.tokens(0, n)).all()


def packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing(docs):
    rows = packing.pack(docs, capacity=128).collect()
    bins = packed(rows, 128)
    assert len(bins) <= -(-sum(r.length for r in rows) // 128) + 2
    want = dict(zip((i * 3 for i in range(len(ODD))), bpe(ODD), strict=True))
    for doc, ids in want.items():
        if doc == 3:
            continue
        own, ids = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece), ids + [2]
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 128 for r in own[1:])
        at = 0
        for r in own:
            assert (r.start, r.ids_crc32) == (at, crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert sum(r.doc_id is None for r in rows) >= 1


def test_plan_matches_largest_with_largest_fit():
    rows = packing.plan({600: 2, 424: 1, 423: 1, 400: 1, 24: 1, 1: 1}, 1024)
    bins = {}
    for size, _, n, first, offset, each in rows.tolist():
        for k in range(n):
            bins.setdefault(first + k // each, []).append((offset + k % each * size, size))
    assert sorted(tuple(s for _, s in sorted(b)) for b in bins.values()) == [(400, 24), (600, 423, 1), (600, 424)] or len(bins) == 3


def test_plan_is_small_and_tight():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5.5, 1.0, 200_000).astype(int), 1, 1024)
    values, n = np.unique(sizes, return_counts=True)
    rows = packing.plan(dict(zip(values.tolist(), n.tolist(), strict=True)))
    assert len(rows) < 20_000 and rows[:, 2].sum() == len(sizes)
    bins = (rows[:, 3] + rows[:, 2] // rows[:, 5]).max()
    assert bins <= 1.002 * sizes.sum() / 1024 + 2


def test_empty_table_and_clashing_names(spark, frame):
    none = frame([])
    assert packing.pack(none).count() == token_counts.token_counts(none).count() == 0
    folder, index = token_files.write_token_files(none)
    assert token_files.read_token_files(spark, folder, index).count() == 0
    clash = frame([(1, "a b", 5, "x", 7)], "doc_id long, text string, rank int, _key string, length long")
    assert packing.pack(clash).count() == 1 and token_counts.token_counts(clash).count() == 1
    assert token_files.write_token_files(clash)[1].count() == 1


def test_a_worker_keeps_one_thing():
    """The tokenizer stays between the tasks of a job and goes when the worker does other work."""
    made = []
    for name in ("a", "a", "b", "b", "a"):
        common.held(name, lambda name=name: made.append(name) or name)
    assert made == ["a", "b", "a"] and list(common._HELD) == ["a"]
    common.forget()
    assert not common._HELD


def test_tokenizer_stays_for_the_next_task(spark, docs):
    packing.pack(docs).count()

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"name": list(common._HELD)}, pa.schema([("name", pa.string())]))

    assert {r.name for r in spark.range(8, numPartitions=8).mapInArrow(kept, "name string").collect()} == {"packing byte_bpe_50k.json"}
