"""The manifest next to a plain recomputation of the tree and its proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siftmill.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, fold=False):
    doc, text, lang, source, n = row
    if fold and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(*map(field, (doc, source, lang, n, text)))


def tree(leaves, fanout=8):
    """Root, and for each leaf its (left, right) siblings from the bottom up."""
    paths, where, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for at, p in enumerate(paths):
            run = where[at] // fanout * fanout
            p.append(("".join(nodes[run : where[at]]), "".join(nodes[where[at] + 1 : run + fanout])))
            where[at] //= fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def expected(rows, tampered=lambda key: False):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    made = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    root, upper = tree([made[g][0] for g in langs])
    out = []
    for g, up in zip(langs, upper, strict=True):
        for r, path in zip(groups[g], made[g][1], strict=True):
            acc = leaf(r, tampered(r[0]))
            for left, right in path + up:
                acc = h(left, acc, right)
            out.append((r[0], leaf(r), made[g][0], root, h(*[x for p in path + up for x in p]), acc, acc == root))
    return sorted(out, key=str)


def rows_of(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def by_three(key):
    return key is not None and zlib.crc32(str(key).encode()) % 3 == 0


def mark():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def documents(sizes):
    out, key = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            key += 1
            out.append((key * 7919 % 10_007, f"Text ÄB {key} Ω🙂", lang, None if key % 5 == 0 else f"S{key % 3}", key))
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1}, {None: 65, "en": 64, "": 2, "é": 1, "z": 1}, {f"l{i}": 1 + i % 3 for i in range(11)}, {"en": 513}])
def test_trees(frame, sizes):
    rows = documents(sizes)
    assert rows_of(manifest.manifest(frame(rows), tampered=mark())) == expected(rows, by_three)


def test_odd_rows(frame):
    rows = [(None, "No key", "en", None, None), (None, None, None, None, None), (5, "", "en", "", 0), (5, "", "en", "", 0), (5, "Other", "en", "", 0)]
    rows += [(i, "Same", "en", "s", 4) for i in (-3, 9, 9, 9)] + [(77, "Long É " * 400_000, "en", "s", 1)]
    df = frame(rows).withColumn("g", F.lit(1)).withColumn("h", F.lit("x")).withColumn("path", F.lit("x"))
    assert rows_of(manifest.manifest(df, tampered=mark())) == expected(rows, by_three)


def test_only_tampered_rows_fail(frame):
    rows = documents({"en": 70, "de": 5})
    found = {r["doc_id"]: r["verified"] for r in manifest.manifest(frame(rows), tampered=mark()).collect()}
    assert found == {r[0]: not by_three(r[0]) for r in rows}
    assert all(r["verified"] for r in manifest.manifest(frame(rows)).collect())


def test_empty(frame):
    assert manifest.manifest(frame([]), tampered=mark()).collect() == []


def test_ranges_do_not_matter(frame, monkeypatch):
    rows = documents({"en": 90, "de": 40, None: 3})
    monkeypatch.setattr(manifest.common, "blocks", lambda *_: 13)
    monkeypatch.setattr(manifest, "ROOTS_BLOCK", 1)
    assert rows_of(manifest.manifest(frame(rows), tampered=mark())) == expected(rows, by_three)
