"""Lattice encoding next to the library, and the round trip."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from siftmill.llm import common, piece_lattice
from siftmill.llm.encode import public_path

NAME = "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a    b ", "Hello world, the tokens: naïve café!", "tabs\tand\nlines\r\n", "ﬁ① 中文字 日本 🙂🙂", "<s> </s> <unk>", "▁ a▁b ▁▁",
    "aaaaaaaaaaaa tttttt mississippi", "don't I'm 'll 12,345.67", "https://x.example.com/a?b=c", "\x00\x01", "word " * 20_000, "x" * 900, "=====----====", "Ünïcödé ßtraße señor",
]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_path(NAME))


def test_equal_to_the_library(frame, sp):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (3, "  ")]
    docs = frame(rows)
    encoded = piece_lattice.encode(docs)
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == sp.encode(r.text or ""), repr((r.text or "")[:40])
    back = {r.doc_id: r.text for r in piece_lattice.decode(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS) if "▁" not in (t or ""))


def test_round_trip_digests(frame, sp):
    rows = piece_lattice.round_trip(frame([(i, t) for i, t in enumerate(TEXTS)])).collect()
    for r in rows:
        ids = sp.encode(TEXTS[r.doc_id] or "")
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.same == ("▁" not in (TEXTS[r.doc_id] or ""))


def test_many_shards_and_odd_tables(frame, sp, monkeypatch):
    monkeypatch.setattr(piece_lattice, "SHARD_WORDS", 3)
    docs = frame([(1, "one two three four five six seven", 1, 2)], "doc_id long, text string, ids int, word int")
    assert [r.ids for r in piece_lattice.encode(docs).collect()] == [sp.encode("one two three four five six seven")]
    assert piece_lattice.encode(frame([])).count() == 0
    ids = frame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in piece_lattice.decode(ids).collect()) == [(1, ""), (2, "")]


def test_only_stable_pairs_follow():
    rank = {"ab": 5, "bc": 3, "abc": 9}
    nodes = piece_lattice.merge_tree("abc", rank)
    assert nodes[0][2:] == (("a", -1, None, None), ("bc", 3, ("b", -1, None, None), ("c", -1, None, None)))
    (whole,) = piece_lattice.merge_tree("bc", rank)
    assert piece_lattice.spine(whole, 2) == [(2, 3, piece_lattice.NEVER), (1, -1, 3)]


def test_round_trip_is_one_python_step(frame):
    """Texts and ids do not go from one set of workers to another."""
    out = piece_lattice.round_trip(frame([(1, "one word"), (2, None)]))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_a_shard_is_read_without_an_object_for_each_word(tmp_path):
    n, rng = 200_000, np.random.default_rng(2)
    keys, ids = rng.integers(-(1 << 62), 1 << 62, n), [np.arange(k % 3 + 1, dtype=np.uint32) + k for k in range(n)]
    (tmp_path / "shard=0").mkdir()
    for part in (slice(0, n // 2), slice(n // 2, n)):
        table = pa.table({"key": keys[part], "n": pa.array([len(x) for x in ids[part]], pa.int32()), "ids": pa.array([x.tobytes() for x in ids[part]], pa.binary())})
        pq.write_table(table, tmp_path / "shard=0" / f"{part.start}.parquet")
    tracemalloc.start()
    known, starts, lengths, flat = piece_lattice._shard(str(tmp_path), 0, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (known == np.sort(keys)).all()
    for k in (0, 1, 99_999, 150_000, n - 1):
        at = np.searchsorted(known, keys[k])
        assert flat[starts[at] : starts[at] + lengths[at]].tolist() == ids[k].tolist()
    assert peak < 64 * n


def test_a_worker_drops_its_shard_for_other_work(tmp_path):
    (tmp_path / "shard=0").mkdir()
    pq.write_table(pa.table({"key": [1], "n": pa.array([0], pa.int32()), "ids": pa.array([b""], pa.binary())}), tmp_path / "shard=0" / "a.parquet")
    piece_lattice._shard(str(tmp_path), 0, 1)
    assert common._HELD
    common.held("other", dict)
    assert list(common._HELD) == ["other"]
    common.forget()


def test_parts_of_a_border_are_found_by_their_length(spark):
    """The fold looks a part up by its length; it walks no list of parts."""
    some = [p for p in piece_lattice.pieces(NAME) if len(p[0]) in (1, 2, 7)][::997]
    short = lambda rank: min(rank + 1, piece_lattice.NEVER)
    part = lambda spine, n: next((short(made) << 20 | short(gone) for k, made, gone in spine if k == n), 0)
    asked = [(i, n, part(left, n), part(right, n)) for piece, i, _, left, right in some for n in range(1, len(piece) + 1)]
    merges = piece_lattice._merges(NAME)
    sides = [piece_lattice._part(merges, side, F.col("id"), F.col("n")).alias(f"got_{side}") for side in ("left", "right")]
    rows = spark.createDataFrame(asked, "id long, n int, left long, right long").select("*", *sides).collect()
    assert rows and all((r.got_left, r.got_right) == (r.left, r.right) for r in rows)


def test_positions_without_longer_pieces(frame, sp):
    texts = ["①the②", "🙂🙂the🙂", "q①", "①②③ the①②", "the①of②and"]
    for r in piece_lattice.encode(frame(list(enumerate(texts)))).collect():
        assert r.ids == sp.encode(r.text)
