"""Exact search next to all inner products."""

import math

import numpy as np
import pytest

from siftmill.llm import nearest

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = set(), {}
    for i, v in usable:
        if i % every == 0:
            asked[i] = min(asked.get(i, (len(v), v.astype(float).tobytes())), (len(v), v.astype(float).tobytes()))
    for i, (n, raw) in asked.items():
        q = np.frombuffer(raw).astype(int)
        found = sorted((-int(q @ v), j) for j, v in usable if j != i and len(v) == n)
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_brute_force(frame, monkeypatch, small):
    if small:
        monkeypatch.setattr(nearest, "CANDIDATES", 40)
        monkeypatch.setattr(nearest, "SEEDS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 24).tolist(), 0) for i in range(0, 900, 3)]
    rows += [(5000 + i, rows[i % 4][1], 1) for i in range(60)]  # a large group of equal vectors: ties
    rows += [(10_000, [1.0, None], 0), (10_001, None, 0), (10_002, [], 0), (10_010, [float("nan")] * 24, 0), (10_020, [float("inf")] * 24, 0), (None, [0.1] * 24, 0)]
    rows += [(20_000, [0.5, 0.5], 0), (20_001, [0.1, -0.7], 0), (20_010, [-0.2, 0.4], 0), (30_000, [2.0], 0), (12, rows[2][1], 0), (12, rows[5][1], 0)]
    got = [tuple(r) for r in nearest.top_k(frame(rows, DDL), every=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 5)


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, (50, 30)).astype(float), rng.integers(-300, 300, (9, 30)).astype(float)
    true = ((x[:, None] - q[None]) ** 2).sum(2)
    last = np.zeros_like(true)
    for n in (1, 3, 15):
        a, b = nearest.statistics(x, n), nearest.statistics(q, n)
        low = ((a[:, None] - b[None]) ** 2).sum(2)
        assert (low <= true + 1e-6).all() and (low >= last - 1e-6).all()
        last = low


def test_odd_tables(frame):
    assert nearest.top_k(frame([], DDL)).count() == 0
    clash = frame([(0, [0.1, 0.2], 1, 2), (1, [0.3, 0.4], 1, 2)], "vec_id long, embedding array<double>, part int, rank int")
    assert [tuple(r) for r in nearest.top_k(clash).collect()] == [(0, 1, 1, 25 * 76 + 51 * 102)]
