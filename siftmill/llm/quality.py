"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one per language, over characters, of order ``ORDER``. Its counts come from all
trusted documents: each task counts its own n-grams, the counts meet in a shuffle, and the
discounted probability of each n-gram and the back-off weight of each context follow from joins
of the count tables. The model is written in shards below the shared folder. A scoring task takes
the different n-grams of a batch and looks them up shard by shard, so neither the driver nor a
task ever holds the whole model, and the texts are never shuffled.

A part of the trusted documents stays out of the counts. The quantiles of their scores give each
language, and in it short and long texts, a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common
from siftmill.plans.sizing import broadcast_if_small

ORDER = 5
BEGIN, END = 2, 3  # code points that stand before and after a text
#: One trusted document in so many, chosen by hash, calibrates instead of being counted.
HELD_OUT = 8
#: A threshold is the last of these held-out quantiles, or where few documents are held out the
#: bound that it exceeds with a chance of 1 in 20 only, judged by the distance of the other two.
QUANTILES, NORMAL_95, NORMAL_99 = (0.5, 0.95, 0.99), 1.645, 2.326
#: Texts of fewer characters have thresholds of their own, and so have longer ones, where at least
#: so many documents of the language and length are held out.
SHORT_CHARS, FEWEST = 1_000, 20
#: Characters of the middle score that every document is credited with: a short one needs more
#: evidence against it.
PRIOR_CHARS = 60.0
SHARD_ROWS = 4 << 20
#: Bytes of text whose n-grams are counted or looked up at once: some fifty times as much memory.
SLICE = 1 << 20
_KEPT_SHARDS: dict[str, tuple] = {}


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of the texts."""
    flat, offsets = arrays.text_bytes(texts)
    opens = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), opens[offsets]


def windows(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of the texts as rows of code points, the n-gram of each predicted
    symbol (every character and the end), and the offsets of the texts in these."""
    points, ends = code_points(texts)
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(n)), n)
    line = np.full(len(points) + order * len(n), BEGIN, np.uint32)
    line[np.arange(len(points)) + doc * order + order - 1] = points
    close = ends[1:] + np.arange(1, len(n) + 1) * order - 1
    line[close] = END
    offsets = np.concatenate([[0], np.cumsum(n + 1)])
    last = np.arange(offsets[-1]) + np.repeat(np.arange(1, len(n) + 1) * (order - 1), n + 1)
    seen = np.zeros(0x110000, bool)
    seen[line] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * order > 63:
        rows, at = np.unique(np.stack([line[last - k] for k in range(order - 1, -1, -1)], 1), axis=0, return_inverse=True)
        return rows, at.ravel(), offsets
    dense = np.zeros(0x110000, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    line = dense[line]
    codes = line.copy()
    for k in range(1, order):
        codes[k:] |= line[:-k] << (bits * k)
    found = pa.array(codes[last]).dictionary_encode()
    packed = np.asarray(found.dictionary)
    rows = np.stack([alphabet[(packed >> (bits * k)) & ((1 << bits) - 1)] for k in range(order - 1, -1, -1)], 1) if len(packed) else np.zeros((0, order), np.uint32)
    return rows, np.asarray(found.indices), offsets


def gram_keys(lang: str, symbols: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams given as rows of code points."""
    import xxhash

    keys = np.full(len(symbols), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(symbols.shape[1]):
            keys = arrays.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + symbols[:, k].astype(np.uint64) + np.uint64(1))
    return keys


def _by_language(batch: pa.RecordBatch):
    langs = batch.column("_lang").dictionary_encode()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, np.flatnonzero(np.asarray(langs.indices) == i)


def _strings(rows: np.ndarray) -> list[str]:
    line = rows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    order = rows.shape[1]
    return [line[i : i + order] for i in range(0, len(line), order)]


def gram_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``gram``, ``c``: how often each n-gram occurs in all texts of ``trusted``."""
    types = common.schema("lang string, gram string, c long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                texts = arrays.plain_texts(part.column("_text"))
                for lang, rows in _by_language(part):
                    grams, at, _ = windows(texts.take(pa.array(rows)), order)
                    yield common.arrow_out({"lang": [lang] * len(grams), "gram": _strings(grams), "c": np.bincount(at, minlength=len(grams))}, types)

    return trusted.select("_lang", "_text").mapInArrow(count, types).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``gram``, ``alpha``, ``gamma`` for the n-grams of every order up to ``order``.

    ``alpha`` is the discounted probability of the last symbol after the others, ``gamma`` the
    weight of the next lower order after this n-gram as a context. Below the highest order a count
    is the number of different symbols before the n-gram. The row of the empty n-gram holds the
    probability of a symbol about which nothing is known. Each order is written: as one plan of all
    orders the driver would hold some fifty exchanges and plan them anew after each.
    """
    alphas, gammas = [], []
    for n in range(order, 0, -1):
        ones = lambda k: F.sum((F.col("c") == k).cast("double"))
        of = counts.groupBy("lang").agg(*[F.greatest(ones(k), F.lit(0.5)).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        discount = [F.greatest(F.lit(0.05), F.least(F.lit(float(k)) - 0.05, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))) for k in (1, 2, 3)]
        of = of.select("lang", *[d.alias(f"d{k}") for k, d in enumerate(discount, 1)])
        rows = counts.join(of, "lang").withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("d", F.least(d, F.col("c").cast("double")))
        contexts = common.cut_lineage(rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"), F.count("*").alias("n")))
        alpha = rows.join(contexts.select("lang", "context", "total"), ["lang", "context"]).select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"))
        alphas.append(common.cut_lineage(alpha))
        gammas.append(contexts.select("lang", F.col("context").alias("gram"), "gamma"))
        if n == 1:
            alphas.append(contexts.select("lang", F.lit("").alias("gram"), (1 / (F.col("n") + 1)).alias("alpha")))
        counts = common.cut_lineage(counts.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")))
    rows = [a.select("lang", "gram", "alpha", F.lit(None).cast("double").alias("gamma")) for a in alphas]
    rows += [g.select("lang", "gram", F.lit(None).cast("double").alias("alpha"), "gamma") for g in gammas]
    joined = rows[0]
    for r in rows[1:]:
        joined = joined.union(r)
    return joined.groupBy("lang", "gram").agg(F.coalesce(F.max("alpha"), F.lit(0.0)).alias("alpha"), F.coalesce(F.max("gamma"), F.lit(1.0)).alias("gamma"))


def write_model(model: DataFrame) -> tuple[str, int]:
    """Write the model in shards of bounded size by the key of the n-gram; folder and shards."""
    types = common.schema("key long, alpha float, gamma float")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, langs = np.array(batch.column("gram").to_pylist(), object), np.array(batch.column("lang").to_pylist(), object)
            lengths, keys = np.array([len(g) for g in grams]), np.zeros(len(grams), np.uint64)
            for lang in set(langs):
                for n in set(lengths):
                    at = np.flatnonzero((langs == lang) & (lengths == n))
                    points = np.frombuffer("".join(grams[at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
                    keys[at] = gram_keys(lang, points)
            yield common.arrow_out({"key": keys.astype(np.int64), "alpha": batch.column("alpha"), "gamma": batch.column("gamma")}, types)

    rows = common.cut_lineage(model.mapInArrow(keyed, types))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    folder = common.shared_folder(model.sparkSession, "model")
    rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(folder)
    return folder, shards


def _shard(folder: str, i: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, alpha and gamma of a shard. A worker keeps the shards of a small model."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    name = f"{folder}/shard={i}"
    if name not in _KEPT_SHARDS:
        files, path = fs.FileSystem.from_uri(name if ":" in name else f"file://{name}")
        table = pq.ParquetDataset(path, filesystem=files, partitioning=None).read() if files.get_file_info(path).type != fs.FileType.NotFound else pa.table({"key": pa.array([], pa.int64()), "alpha": pa.array([], pa.float32()), "gamma": pa.array([], pa.float32())})
        keys, alpha, gamma = (np.asarray(table.column(c)) for c in ("key", "alpha", "gamma"))
        del table
        if (keys[1:] < keys[:-1]).any():  # more than one file
            order = np.argsort(keys)
            keys, alpha, gamma = keys[order], alpha[order], gamma[order]
        found = keys, alpha, gamma
        if shards > 2:
            return found
        if any(not kept.startswith(f"{folder}/") for kept in _KEPT_SHARDS):
            _KEPT_SHARDS.clear()  # of a model that is done with
        _KEPT_SHARDS[name] = found
    return _KEPT_SHARDS[name]


def _look_up(folder: str, shards: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``alpha`` and ``gamma`` of keys, 0 and 1 where the model has none; one shard at a time."""
    keys = keys.astype(np.int64)
    alpha, gamma = np.zeros(len(keys)), np.ones(len(keys))
    of = np.mod(keys, shards)
    for i in range(shards):
        at = np.flatnonzero(of == i) if shards > 1 else np.arange(len(keys))
        known, a, g = _shard(folder, i, shards)
        if len(at) and len(known):
            place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            hit = known[place] == keys[at]
            alpha[at[hit]], gamma[at[hit]] = a[place[hit]], g[place[hit]]
    return alpha, gamma


def surprise(folder: str, shards: int, lang: str, grams: np.ndarray) -> np.ndarray | None:
    """Negative log probability of the last symbol of each n-gram; None without a model."""
    order = grams.shape[1]
    base, _ = _look_up(folder, shards, gram_keys(lang, grams[:1, :0]))
    if not base[0]:
        return None
    keys = [gram_keys(lang, grams[:, order - n :]) for n in range(1, order + 1)] + [gram_keys(lang, grams[:, order - n : order - 1]) for n in range(1, order + 1)]
    alpha, gamma = (x.reshape(2 * order, -1) for x in _look_up(folder, shards, np.concatenate(keys)))
    p = np.full(len(grams), base[0])
    for n in range(order):
        p = alpha[n] + gamma[order + n] * p
    return -np.log(p)


def scores(rows: DataFrame, folder: str, shards: int, order: int = ORDER) -> DataFrame:
    """``n_chars`` and ``loss`` (summed negative log probability; null without a model) per row."""
    types = common.schema("_key long, _lang string, _fold int, n_chars long, n_ink long, loss double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        common.forget()
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                texts, loss, known = arrays.plain_texts(part.column("_text")), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                for lang, mine in _by_language(part):
                    grams, at, ends = windows(texts.take(pa.array(mine)), order)
                    nats = surprise(folder, shards, lang, grams)
                    if nats is not None:
                        known[mine], loss[mine] = True, arrays.segment_sums(nats[at], ends)
                n, ink = pc.utf8_length(texts), pc.utf8_length(pc.utf8_trim_whitespace(texts))
                yield common.arrow_out({c: part.column(c) for c in ("_key", "_lang", "_fold")} | {"n_chars": n, "n_ink": ink, "loss": pa.array(loss, mask=~known)}, types)
        _KEPT_SHARDS.clear()  # the worker goes on with other work

    return rows.select("_key", "_lang", "_fold", "_text").mapInArrow(score, types)


def excess_limits(held: DataFrame, out) -> DataFrame:
    """``_lang``, ``short``, ``reach``: the largest excess over the middle that a text may have.

    From the held-out documents of the language and length if they are ``FEWEST`` or more, else
    from those of the language; then their spread is at least that of all its trusted documents.
    """

    def summary(side, name: str) -> list:
        return [F.count(F.when(side, 1)).alias(f"n_{name}"), F.percentile_approx(F.when(side, F.col("excess")), list(QUANTILES), 10_000).alias(f"q_{name}")]

    def bound(n, q, spread):
        # The usual approximation of a one-sided normal tolerance factor; that of few documents is large.
        a = F.greatest(1 - NORMAL_95**2 / (2 * F.greatest(n - 1, F.lit(1))), F.lit(0.1))
        b = NORMAL_99**2 - NORMAL_95**2 / n
        factor = (NORMAL_99 + F.sqrt(NORMAL_99**2 - a * b)) / a
        return F.greatest(q[2], q[0] + factor * spread / NORMAL_95)

    def apart(q):
        return q[1] - q[0]

    by_lang = held.groupBy("_lang").agg(*summary(out, "out"), *summary(F.lit(True), "all"))
    few_n, few_q = F.when(F.col("n_out") > 0, F.col("n_out")).otherwise(F.col("n_all")), F.coalesce("q_out", "q_all")
    wide = by_lang.select("_lang", bound(few_n, few_q, F.greatest(apart(few_q), apart(F.col("q_all")))).alias("wide"))
    own = held.groupBy("_lang", "short").agg(*summary(out, "own"))
    own = own.where(F.col("n_own") >= FEWEST).select("_lang", "short", bound(F.col("n_own"), F.col("q_own"), apart(F.col("q_own"))).alias("own"))
    every = wide.withColumn("short", F.explode(F.array(F.lit(True), F.lit(False))))
    return every.join(own, ["_lang", "short"], "left").select("_lang", "short", F.coalesce("own", "wide").alias("reach"))


def classify(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """One row for each row of ``df``: key, language, ``n_chars``, ``perplexity``, ``threshold``, ``kept``.

    ``trusted`` holds the keys of trusted documents in its first column; repeated or null keys in
    it do not matter. A row is rejected when its mean loss, with ``PRIOR_CHARS`` characters of its
    language's middle loss added, lies above the threshold of its language and length. A null or empty text, or one of white
    space only, is rejected. A null language is a language of its own; a language without trusted
    text has no model: perplexity and threshold are null and its documents are kept. Repeated rows
    and null keys are judged row by row; other columns are ignored; an empty table gives an empty
    result.
    """
    names = trusted.select(F.col(trusted.columns[0]).cast("long").alias("_trusted")).where("_trusted is not null").distinct()
    rows = df.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("_text"))
    rows = rows.join(broadcast_if_small(common.cut_lineage(names)), F.col("_key") == F.col("_trusted"), "left")
    fold = F.when(F.col("_trusted").isNotNull(), F.pmod(F.xxhash64("_key"), F.lit(HELD_OUT)).cast("int"))
    rows = rows.withColumn("_fold", fold)  # 0 calibrates, others are counted, null is not trusted
    model = kneser_ney(common.cut_lineage(gram_counts(rows.where("_fold > 0"), order)), order)
    scored = common.cut_lineage(scores(rows, *write_model(model), order))
    mean = F.col("loss") / (F.col("n_chars") + 1)
    held = scored.where("n_ink > 0 and loss is not null and _fold is not null")
    # A language whose held-out part is empty is calibrated on all its trusted documents.
    out = F.col("_fold") == 0
    sides = held.groupBy("_lang").agg(*[F.percentile_approx(F.when(side, mean), 0.5, 10_000).alias(n) for n, side in (("out", out), ("all", F.lit(True)))])
    middles = broadcast_if_small(common.cut_lineage(sides.select("_lang", F.coalesce("out", "all").alias("middle"))))
    scored = scored.join(middles, "_lang", "left").withColumn("short", F.col("n_chars") < SHORT_CHARS)
    scored = scored.withColumn("excess", (F.col("loss") - F.col("middle") * (F.col("n_chars") + 1)) / (F.col("n_chars") + 1 + PRIOR_CHARS))
    held = scored.where("n_ink > 0 and loss is not null and _fold is not null")
    limits = broadcast_if_small(common.cut_lineage(excess_limits(held, out)))
    judged = scored.join(limits, ["_lang", "short"], "left").withColumn("limit", F.col("middle") + F.col("reach"))
    kept = (F.col("n_ink") > 0) & F.coalesce(F.col("excess") <= F.col("reach"), F.lit(True))
    named = F.when(F.col("_lang") != "", F.col("_lang"))
    return judged.select(F.col("_key").alias(key), named.alias(lang), "n_chars", F.exp(mean).alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))


def keep_good(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` without the rows that ``classify`` rejects; rows of one key go or stay together."""
    return common.without(df, key, classify(df, trusted, key, text, lang).where("not kept").select(key))
