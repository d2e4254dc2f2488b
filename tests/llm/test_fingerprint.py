"""Digests next to a plain computation window by window."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftmill.llm import arrays, fingerprint


def plain_level(window: bytes) -> int:
    return sum(int(fingerprint._TERM[c]) for c in Counter(window).values()) >> 12


def plain_selected(levels, rank):
    score = Counter()
    spans = range(max(1, len(levels) - fingerprint.SPAN + 1)) if levels else []
    for i in spans:
        here = [rank[x] for x in levels[i : i + fingerprint.SPAN]]
        score[i + here.index(min(here))] += 1 if len(levels) >= fingerprint.SPAN else fingerprint.OFTEN
    return sorted(i for i, n in score.items() if n >= fingerprint.OFTEN)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij éß") for _ in range(rng.randrange(2, 9))) for _ in range(80)]
    return [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 3, 12, 14, 40, 100, 300)] + ["", "x" * 500, "中文" * 90, "ab" * 32]


def test_levels_and_selection(texts):
    rank = np.random.default_rng(1).permutation(fingerprint.LEVELS + 1)
    flat, offsets = arrays.text_bytes(pa.array(texts, pa.large_string()))
    level, at, ends = fingerprint.entropies(flat, offsets)
    chosen = fingerprint.selected(level, ends, rank)
    for i, t in enumerate(texts):
        raw = t.encode()
        want = [plain_level(raw[k : k + 64]) for k in range(max(0, len(raw) - 63))]
        assert level[ends[i] : ends[i + 1]].tolist() == want
        mine = chosen[(chosen >= ends[i]) & (chosen < ends[i + 1])] - ends[i]
        assert mine.tolist() == plain_selected(want, rank)
    assert math.isclose(plain_level(bytes(range(64))), fingerprint.LEVELS, abs_tol=1) and plain_level(b"a" * 64) == 0


def test_likeness():
    rng = np.random.default_rng(2)
    a, b, c = (fingerprint.chain(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (150, 150, 700))
    assert fingerprint.likeness(a, a) == 1.0 and fingerprint.likeness(c, c) == 1.0 and fingerprint.likeness(a, b) < 0.1
    assert fingerprint.likeness(a, c) == fingerprint.likeness(c, a) and len(c) == 5
    none = fingerprint.whole_digest(np.zeros(0, np.uint8))
    assert fingerprint.likeness(none, none) == 1.0 and fingerprint.likeness(none, a) == 0.0
    assert (fingerprint.from_text(fingerprint.as_text(c)) == c).all()


def test_whole_table(frame, texts, monkeypatch):
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(None, "no key here"), (101, None), (4, texts[2]), (102, "long text " * 20_000), (103, texts[6]), (104, texts[6] + " more")]
    got = sorted(fingerprint.fingerprints(frame(rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    monkeypatch.setattr(fingerprint.common, "blocks", lambda df: 5)
    cut = sorted(fingerprint.fingerprints(frame(rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows) and [tuple(r) for r in cut] == [tuple(r) for r in got]
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    prints = {}
    for r, (k, t), (_, after) in zip(got, ordered, ordered[1:] + ordered[:1], strict=True):
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (k, len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_edited == fingerprint.likeness(fingerprint.from_text(r.fingerprint), fingerprint.from_text(r.edited_fingerprint))
    by_key = {r.doc_id: r for r in got}
    assert by_key[103].near_next > 0.8 and by_key[8].near_edited > 0.2 > by_key[8].near_next


def test_small_and_clashing_tables(frame):
    assert fingerprint.fingerprints(frame([])).count() == 0
    one = fingerprint.fingerprints(frame([(7, "alone", 1, 2)], "doc_id long, text string, _block int, near_next int")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"aloal").hexdigest()


def test_every_text_has_a_feature():
    rng = random.Random(11)
    rank = np.random.default_rng(3).permutation(fingerprint.LEVELS + 1)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    short = ["".join(rng.choice(letters) for _ in range(n)) for n in range(127, 142)]
    periodic = [(c * 600)[:n] for c, n in (("x", 500), ("yz", 500), ("word ", 20_000), ("another ", 9_000), ("fifteen letters", 300))]
    texts = short + periodic + ["", "tiny", "".join(rng.choice(letters) for _ in range(3_000))]
    found = fingerprint.digests(pa.array(texts, pa.large_string()), rank)
    assert [bool(f.any()) for f in found] == [bool(t) for t in texts]
    for i in range(len(texts)):
        assert fingerprint.likeness(found[i], found[i]) == 1.0
        assert all(fingerprint.likeness(found[i], found[k]) < 0.5 for k in range(i))
    # One more word or period, across the length from which every window can be selected.
    grown = [t + " and one more word" for t in short] + [t + t[: len(c)] for t, c in zip(periodic, ("x", "yz", "word ", "another ", "fifteen letters"), strict=True)]
    after = fingerprint.digests(pa.array(grown, pa.large_string()), rank)
    alike = [fingerprint.likeness(a, b) for a, b in zip(found, after, strict=False)]
    assert np.mean(np.array(alike[: len(short)]) > 0.4) > 0.8 and min(alike[len(short) :]) > 0.9
    # A text's features do not depend on its neighbours in the batch.
    assert all((fingerprint.digests(pa.array([t], pa.large_string()), rank)[0] == f).all() for t, f in zip(texts, found, strict=True))
