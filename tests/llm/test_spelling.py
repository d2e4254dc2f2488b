"""Spelling variants next to brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from siftmill.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts, times=10):
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in close.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(close[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def words(rng, alphabet, n, least, most):
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(least, most))): rng.choice([2, 3, 9, 29, 30, 400]) for _ in range(n)}


@pytest.mark.parametrize("part", [7, 100_000])
@pytest.mark.parametrize("alphabet,least,most", [("ab", 1, 8), ("aé÷z", 3, 6), ("abcdefgh", 2, 3)])
def test_all_pairs(spark, monkeypatch, part, alphabet, least, most):
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    counts = words(random.Random(part + most), alphabet, 250, least, most)
    counts.update({"a" * 30: 5, "a" * 29: 50, "a" * 28: 500, "a" * 27: 5000})
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(df)) == expected(counts)


def test_chain_and_ties(spark):
    counts = {"abcdefg": 10_000, "abcdefx": 1_000, "abcdefgh": 10_000, "abcdxfx": 100, "abyyxfx": 10, "abyyxfxx": 1, "lonely": 3}
    got = {r[0]: r for r in rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n int")))}
    assert got["abcdxfx"][1:3] == ("abcdefx", "abcdefg") and got["abcdefx"][1] == "abcdefg"
    assert got["abyyxfxx"][1:3] == ("abyyxfx", "abyyxfx") and got["lonely"][1:] == (None, "lonely", 3, 0, None)
    assert sorted(got.values()) == expected(counts)


def test_counts(frame):
    texts = ["Straßen straßen STRASSEN", "Hello-hello hellos HELLOS", "", None, "Ünwahrs Ünwahrs ünwahrs", "word1234567word", "naïveté×naïveté", "long enough words words long " * 20_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "Straßen Straßen"), (0, "Straßen"), (0, "Straßen")]
    for slips in (None, 2):
        want = Counter()
        for key, text in docs:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if slips and h % slips == 0 else run] += 1
        for chars in (4, 7):
            got = {r["word"]: r["n"] for r in spelling.word_counts(frame(docs), least_chars=chars, slips=slips).collect()}
            assert got == {w: n for w, n in want.items() if len(w) >= chars and n >= 2}


def test_empty_null_and_clashing(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert rows_of(spelling.variants(empty)) == []
    rows = [("abc", 40, 1, "x"), ("abd", 3, 2, None), (None, 9, 3, "y"), ("", 9, 4, "z")]
    df = spark.createDataFrame(rows, "word string, n long, place int, root string")
    assert rows_of(spelling.variants(df)) == expected({"abc": 40, "abd": 3})
