"""Near copies next to brute force over all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siftmill.llm import common, near_copies


def shingle_set(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def brute(rows, width, percent=80):
    sets = [(k, shingle_set(t, width)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(s), find(k), find(k) == k) for k, s in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["É", "ß", "the", "of"]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 30, 90, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, len(base) // 12])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.02 and w.isascii() else w for w in own))
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) for _ in range(40)]
    texts += ["", None, " \t\n", "one", "ONE", "two words", "Two\twords", "a\x0bb", "a b", "a b", "long " * 30_000]
    rng.shuffle(texts)
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width", [2, 5])
def test_equal_to_brute_force(frame, corpus, width):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_copies.near_copies(frame(corpus), width=width).collect()}
    assert got == brute(corpus, width)


def test_left_over_pairs_in_cut_buckets(frame, corpus, monkeypatch):
    monkeypatch.setattr(near_copies, "PART", 2)
    monkeypatch.setattr(near_copies, "BAND", 1)  # every bucket mixes many classes
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_copies.near_copies(frame(corpus[:120]), width=2).collect()}
    assert got == brute(corpus[:120], 2)


def test_chain_of_links(frame):
    base = [f"x{i}" for i in range(100)]
    rows = [(50 - k, " ".join(base[k * 4 :] + [f"y{i}" for i in range(k * 4)])) for k in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_copies.near_copies(frame(rows), width=2).collect()}
    assert got == brute(rows, 2) and len({v[1] for v in got.values()}) < 12


def test_odd_rows(frame, spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "a b c"), (9, "q r s"), (9, "a b c"), (8, "q r s")]
    out = near_copies.near_copies(frame(rows), width=2).collect()
    assert len(out) == len(rows)
    assert {(r.component_id, r.kept) for r in out if r.doc_id is None} == {(None, True)}
    assert {r.component_id for r in out if r.doc_id} == {2}
    assert near_copies.near_copies(frame([])).count() == 0
    clash = frame([(1, "a b", 5, "x", 7), (2, "A b", 5, "x", 7)], "doc_id long, text string, rep int, set_hash string, component_id long")
    kept = near_copies.drop_near_copies(clash).collect()
    assert [r.doc_id for r in kept] == [1] and kept[0].rep == 5


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 6000).astype(np.uint64)
    for shared in (0, 1000, 2000, 3600):
        a, b = pool[:4000], pool[4000 - shared : 8000 - 2 * shared][: 4000 - 0]
        b = np.concatenate([pool[:shared], pool[4000 : 4000 + min(2000, 4000 - shared)]])
        sk = near_copies.registers(np.concatenate([a, b, a, b]), np.array([0, len(a), len(a) + len(b), 2 * (len(a) + len(b))]))
        assert (np.maximum(sk[0], sk[1]) == sk[2]).all()
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = near_copies.likelihood_estimate(sk[:1], sk[1:2], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(est - truth) < 0.12


def test_shingles_of_short_texts():
    hashes, ends = near_copies.shingles(pa.array(["a b c", "A  b", "x", "", "a b"], pa.large_string()), 3)
    assert np.diff(ends).tolist() == [1, 1, 1, 0, 1] and hashes[ends[1]] == hashes[ends[4]] != hashes[0]


@pytest.mark.parametrize("n,most,portions", [(4096, None, 12), (700, 2, None)])
def test_thousands_of_classes_in_one_bucket_fit(n, most, portions):
    """Classes alike in their sketches that all stay apart: memory follows the portions, not the pairs."""
    import itertools
    import tracemalloc

    rng = np.random.default_rng(1)
    sketch = np.tile(rng.integers(50, 60, near_copies.REGISTERS).astype(np.uint8), (n, 1))
    at = rng.integers(near_copies.BAND, near_copies.REGISTERS, (n, 20))
    sketch[np.arange(n)[:, None], at] += rng.integers(1, 40, (n, 20)).astype(np.uint8)
    flat = np.zeros(n, np.int64)
    rows = {"group": flat, "guest": flat > 0, "n": np.full(n, 100.0), "part": flat, "cross": flat > 0, "root": np.arange(n), "band": flat, "rep": np.arange(n) * 7, "sketch": sketch}
    tracemalloc.start()
    found = sum(len(a) for a, _ in itertools.islice(near_copies._chosen(rows, 0.6, 0.8, most), portions))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= n and (most is None or found <= most * n) and peak < 500 << 20


def test_ranked_pairs_are_the_closest():
    """Portions and early drops do not change which partners a class names."""
    rng = np.random.default_rng(2)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    alike, rep = rng.integers(0, 5, len(i)) / 4.0, rng.permutation(40)
    got = {(a, b) for a, b in zip(*near_copies._closest(i, j, alike, rep, 3)[:2], strict=True)}
    want = {(a, b) for a in range(40) for b in sorted(range(40), key=lambda b: (-alike[(i == a) & (j == b)][0], rep[b]))[:3]}
    assert got == want


def test_memory_of_a_task_follows_the_slice(spark):
    """Arrays of shingles take many times the bytes of their text: a task must not make them for a whole batch."""
    text = " ".join(f"w{i}" for i in range(400))
    batch = pa.RecordBatch.from_pydict({"_key": list(range(6000)), "_text": [f"{i} {text}" for i in range(6000)]})  # 11 MB of text
    types = common.schema(near_copies._SKETCHED)
    tracemalloc.start()
    n = sum(part.num_rows for part in near_copies._sketched(batch, 2, types))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 and peak < 100e6


def test_bit_maps_lose_no_link_and_drop_what_lies_below():
    rng = np.random.default_rng(1)
    sets = []
    for n in (3, 40, 130, 900, 30_000):
        base = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
        for changed in (0, 0.02, 0.08, 0.1, 0.11, 0.12, 0.14, 0.16, 0.2):
            k = round(changed * n)
            sets.append(np.unique(np.concatenate([base[: len(base) - k + k // 7], rng.integers(0, 1 << 63, k, np.int64).astype(np.uint64)])))
    maps, n = near_copies.Maps([near_copies.bit_map(s) for s in sets]), np.array([len(s) for s in sets], np.float64)
    i, j = (x.ravel() for x in np.indices((len(sets),) * 2))
    same = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    alike = same / (n[i] + n[j] - same)
    for percent in (57, 80):
        kept = maps.may_reach(i, j, n[i], n[j], percent)
        assert kept[100 * same >= percent * (n[i] + n[j] - same)].all()
        assert not kept[(alike < percent / 100 - 0.04) & (np.minimum(n[i], n[j]) < 1000)].any()


def test_a_group_without_pairs_left_out_is_not_dealt_again(frame, corpus, monkeypatch):
    dealt, compared = [], near_copies._compared
    monkeypatch.setattr(near_copies, "BAND", 2)
    monkeypatch.setattr(near_copies, "_compared", lambda groups, *rest: dealt.append(groups.count()) or compared(groups, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_copies.near_copies(frame(corpus[:120]), width=2).collect()}
    assert got == brute(corpus[:120], 2)
    assert dealt[0] > 0 and sum(dealt) < 1.5 * dealt[0]


@pytest.mark.parametrize("n", [64, 256])
def test_rows_of_a_large_group_follow_its_members(spark, monkeypatch, n):
    """All but three members of a bucket are linked: they meet these three, not each other."""
    monkeypatch.setattr(near_copies, "PART", 4)
    members = spark.createDataFrame([(1, 0, k, 100) for k in range(n)], "bucket long, band int, rep long, n long")
    classes = spark.createDataFrame([(k, b"", b"") for k in range(n)], "rep long, sketch binary, bits binary")
    roots = spark.createDataFrame([(k, 0) for k in range(n - 3)], "node long, root long")
    rows = near_copies._groups(members, classes, roots, 0.8).where("not guest").collect()
    assert len(rows) <= 2 * n
    met = {(r.bucket, r.p, r.q): [x for x in rows if (x.p, x.q) == (r.p, r.q)] for r in rows}
    pairs = [tuple(sorted((a.rep, b.rep))) for (_, p, q), group in met.items() for a in group for b in group if a.rep < b.rep and a.root != b.root and (p == q or a.part != b.part)]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(max(a + 1, n - 3), n)]
