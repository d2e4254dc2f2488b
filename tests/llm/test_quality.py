"""The Kneser-Ney model next to a plain computation, and the decisions on planted junk."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftmill.llm import quality


def brute_model(texts, order):
    """Probability function of an interpolated modified Kneser-Ney model, from its definition."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        line = "\x02" * (order - 1) + t + "\x03"
        counts[order].update(line[i : i + order] for i in range(len(line) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    tables = []
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = (max(of[k], 0.5) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, spent = defaultdict(float), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            spent[g[:-1]] += min(d[min(c, 3) - 1], c)
        tables.append((counts[n], d, total, spent))

    def p(gram):
        value = 1 / (len(counts[1]) + 1)
        for n, (own, d, total, spent) in enumerate(tables, 1):
            g = gram[order - n :]
            context = g[:-1]
            if context in total:
                c = own[g]
                value = (max(c - min(d[min(c, 3) - 1], c), 0) if c else 0) / total[context] + spent[context] / total[context] * value
        return value

    return p


def prose(rng, words):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "élan", "tempor"]) for _ in range(words)) + "."


def test_probabilities_equal_the_definition(spark, frame):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (3, 9, 20, 40)] + [""]
    rows = frame([(i, t, "xx") for i, t in enumerate(texts)]).withColumnsRenamed({"lang": "_lang", "text": "_text"})
    folder, shards = quality.write_model(quality.kneser_ney(quality.gram_counts(rows.select("_lang", "_text"), 4), 4))
    p = brute_model(texts, 4)
    asked = pa.array(["dolor sit", "zzz lorem", "", "élan Ω"], pa.large_string())
    grams, at, ends = quality.windows(asked, 4)
    got = quality.surprise(folder, shards, "xx", grams)
    for row, nats in zip(grams, got, strict=True):
        assert math.isclose(nats, -math.log(p("".join(map(chr, row)))), rel_tol=1e-5)
    assert np.diff(ends).tolist() == [10, 10, 1, 7] and quality.surprise(folder, shards, "yy", grams) is None
    known = {x for t in texts for x in t} | {"\x03"}
    assert math.isclose(sum(p("\x02lo" + x) for x in known) + p("\x02loΩ"), 1, abs_tol=1e-9)


def test_many_shards_give_the_same(spark, frame, monkeypatch):
    rng = random.Random(2)
    rows = frame([(i, prose(rng, 30), "xx") for i in range(5)]).withColumnsRenamed({"lang": "_lang", "text": "_text"}).select("_lang", "_text")
    model = quality.kneser_ney(quality.gram_counts(rows, 3), 3).persist()
    grams, _, _ = quality.windows(pa.array(["lorem amet?"], pa.large_string()), 3)
    one = quality.surprise(*quality.write_model(model), "xx", grams)
    monkeypatch.setattr(quality, "SHARD_ROWS", 20)
    folder, shards = quality.write_model(model)
    assert shards > 3 and np.allclose(one, quality.surprise(folder, shards, "xx", grams))


def test_wide_alphabets_keep_all_symbols():
    text = "".join(chr(0x4E00 + i) for i in range(9000))
    grams, at, ends = quality.windows(pa.array([text, "ab"], pa.large_string()), 5)
    line = "\x02" * 4 + text + "\x03"
    assert "".join(map(chr, grams[at[4000]])) == line[4000:4005] and np.diff(ends).tolist() == [9001, 3]


@pytest.fixture(scope="module")
def judged(spark, frame):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([4, 30, 200])), "xx") for i in range(120)]
    rows += [(200 + i, "".join(rng.choice("#$%&|@") + rng.choice("QWXZ") for _ in range(300)), "xx") for i in range(10)]
    rows += [(300, None, "xx"), (301, "", "xx"), (302, " \n ", "xx"), (303, "kept without a model", "yy"), (304, prose(rng, 9), None), (None, prose(rng, 50), "xx"), (5, prose(rng, 20), "xx"), (306, "x", "xx"), (307, prose(rng, 40_000), "xx")]
    docs = frame(rows)
    names = spark.createDataFrame([(i,) for i in range(80)] + [(3,), (None,)], "doc_id long")
    return docs, names, quality.classify(docs, names).collect(), len(rows)


def test_decisions(judged):
    docs, names, rows, n = judged
    assert len(rows) == n
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i in range(120)) and not any(kept[200 + i] for i in range(10))
    assert [kept[i] for i in (300, 301, 302)] == [False] * 3 and kept[303] and kept[304] and kept[None] and kept[307]
    by_id = {r.doc_id: r for r in rows}
    assert by_id[303].perplexity is None and by_id[304].lang is None and by_id[300].n_chars == 0


def test_filter_keeps_columns(judged, frame, spark):
    docs, names, _, _ = judged
    assert quality.keep_good(docs, names).columns == docs.columns
    assert quality.classify(frame([]), names).count() == 0
    assert quality.classify(docs, names.where("false")).where("not kept").count() == 3  # no model: only texts without ink go
    clash = frame([(1, "a b", "xx", 5, 7)], "doc_id long, text string, lang string, loss int, _gone int")
    assert quality.keep_good(clash, names).count() == 1


def test_repetition_and_menus_are_rejected(spark, frame):
    rng = random.Random(21)
    words = ["".join(rng.choice(["lo", "rem", "ip", "sum", "do", "lor", "ta", "ne"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    after = {w: rng.sample(words, 6) for w in words}

    def chained(n):
        line = [rng.choice(words)]
        while len(line) < n:
            line.append(rng.choice(after[line[-1]]))
        return " ".join(line) + "."

    good = [(i, chained(rng.choice([5, 30, 200, 400])), "xx") for i in range(400)]
    junk = {}
    for i in range(30):
        w = rng.choice(["ip", "Thsh", "mmm", "tane"])
        junk[1000 + i] = chained(100) + "\n" + f"{w} " * 150
        junk[2000 + i] = chained(150) + "\n" + " | ".join(rng.choice(words) for _ in range(40))
    names = spark.createDataFrame([(i,) for i in range(300)], "doc_id long")
    kept = {r.doc_id: r.kept for r in quality.classify(frame(good + [(k, t, "xx") for k, t in junk.items()]), names).collect()}
    of = [np.mean([kept[lo + i] for i in range(n)]) for lo, n in ((300, 100), (1000, 30), (2000, 30))]
    assert of[0] >= 0.97 and of[1] < 0.4 and of[2] < 0.1, of


def test_the_orders_of_a_model_are_planned_one_by_one(frame):
    rows = frame([(1, "abcabd"), (2, "abd abe")], "doc_id long, _text string, _lang string").select("_lang", "_text")
    model = quality.kneser_ney(quality.gram_counts(rows, 4), 4)
    assert model._jdf.queryExecution().executedPlan().toString().count("Exchange") < 5
