"""The classifier: features against plain string code, held-out accuracy, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftmill.llm import toxicity

ODD = ["", " ", "a", "abc", "abcd", "  two  words\n\tand\x0bmore ", "ünïcödé 🙂🙂🙂🙂🙂 中文中文中文中文中", "x" * 50, None, "tail"]


def plain(text):
    """All n-grams of the words of a text with the spaces beside them."""
    out = set()
    for word in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" "):
        s = f" {word} "
        out |= {s[i : i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1)}
    return {g for g in out if " " not in g[1:-1]}


@pytest.mark.parametrize("block", [5, 1 << 18])
def test_features(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    texts = pa.array([t or "" for t in ODD], pa.large_string())
    line, ends = toxicity.padded(texts)
    chars = line.astype("<u4").tobytes().decode("utf-32-le")
    who, feature = toxicity.present(texts)
    found = [set(feature[who == i].tolist()) for i in range(len(ODD))]
    for t, hashes in zip(ODD, found, strict=True):
        assert len(hashes) == len(plain(t))  # no two of these n-grams share a hash
    assert chars.count(" ") >= 2 * len(ODD) and ends[-1] == len(line)
    same = toxicity.present(pa.array(["zz tail", "tail"], pa.large_string()))
    assert found[-1] <= set(same[1][same[0] == 0].tolist()) and found[-1] == set(same[1][same[0] == 1].tolist())


def corpus(rng, n, toxic_share=0.15):
    syllables = ["an", "ber", "ch", "de", "en", "fi", "ge", "hu", "ing", "ka", "lo", "mi"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))]
        bad = rng.random() < toxic_share
        for _ in range(rng.randint(1, 3) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["wretch", "vermin", "filth"]) + rng.choice(["", "s", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(frame, spark):
    rows, labels = corpus(random.Random(3), 900)
    labels = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    docs = frame(rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs, labels.where(~held))
    told = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = toxicity.score(docs, model, held_out=held).join(told, "doc_id").where("held_out").collect()
    wrong = [r for r in got if r["predicted"] != r["toxic"]]
    assert len(got) > 150 and len(wrong) <= 0.03 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    # Position and length do not hide a word, and the order of rows does not matter.
    long = frame([(1, "an ber " * 200_000 + "vermin"), (2, "an ber " * 200_000), (None, "vermin filth"), (3, None), (3, ""), (3, "")])
    scores = [(r["doc_id"], r["predicted"], r["score"]) for r in toxicity.score(long, model).collect()]
    assert {(k, p) for k, p, _ in scores} == {(1, 1), (2, 0), (None, 1), (3, 0)} and len(scores) == 6
    assert len({s for k, _, s in scores if k == 3}) == 1


def test_few_labels(frame, spark):
    docs = frame([(1, "one text"), (2, "another text"), (3, None)])
    ddl = "doc_id long, toxic int"
    for labels, want in (([], 0), ([(1, 1)], 1), ([(1, 0), (2, 0)], 0), ([(1, None), (9, 1)], 0), ([(1, 1), (2, 0)], None)):
        rows = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, ddl))).collect()
        assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
        assert want is None or {r["predicted"] for r in rows} == {want}


def test_empty_and_clashing(frame, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    empty = frame([])
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []
    docs = frame([(1, "vermin vermins"), (2, "good text")]).withColumns({"toxic": F.lit(5), "score": F.lit("x"), "held_out": F.lit("y")})
    assert toxicity.score(docs, toxicity.fit(docs, labels)).columns == ["doc_id", "held_out", "score", "predicted"]


def test_labels_are_no_input(frame, spark):
    rows, labels = corpus(random.Random(5), 300)
    model = toxicity.fit(frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [t for _, t in rows[:40]]
    one = frame([(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    two = frame([(1000 - i, t, "xx", None, None) for i, t in enumerate(texts)])
    by_text = [np.sort([r["score"] for r in toxicity.score(d, model).collect()]) for d in (one, two)]
    assert np.allclose(*by_text)
