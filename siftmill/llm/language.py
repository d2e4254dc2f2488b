"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: likelihood of the character trigrams under each language, fitted on labelled documents.
* Declared language: how often each declared value goes with each language of the text.
* Address suffix: the same for the last label of the host name.
* Host: a prior per host, smoothed towards its domain and that towards all rows. The counts are
  grouped sums of what the texts alone say, and leave the row itself out.

These choose among the labelled languages. Whether a text is in any of them is decided by its mean
log likelihood: it may not lie farther below the middle of its language's own documents than half
the way from nearly all of these to a text of uniform trigrams. Short texts need more evidence.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common
from siftmill.llm.quality import code_points
from siftmill.plans.distribution import quantile_points
from siftmill.plans.ordered import plan_buckets
from siftmill.plans.sizing import broadcast_if_small
from siftmill.plans.skew import hot_split_join

BUCKETS = 1 << 15
#: Bytes of text whose trigrams a task holds at once.
SLICE = 1 << 20
#: At most so many languages, those with most labelled documents.
MOST_LANGUAGES = 200
#: Trigrams of a text count as independent up to so many, and each as this share of one.
STRONG_TRIGRAMS, SHARE = 300, 0.4
#: Weight, in rows, of the parent in a smoothed host prior and of agreement in a declared value.
HOST_WEIGHT, DECLARED_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0, 20.0
LEAST_POSTERIOR = 0.6
#: This share of a language's own documents bounds how unlikely its texts may be.
OWN_SHARE = 0.99
#: Hosts with more than this share of the rows are answered by a broadcast of their few rows.
HOT_HOST = 1e-3

_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.I | re.S)


def declared_language(page: str) -> str | None:
    """Primary language of the markup's own declaration."""
    found = _LANG.search(page) or _META.search(page)
    return found[1].lower() if found else None


def visible_text(page: str) -> str:
    """Text of a page without markup."""
    return markup.unescape(_HIDDEN.sub(" ", page))


def host_parts(url: str | None) -> tuple[str, str, str]:
    """Host name, its last two labels and its last label; empty where there is none."""
    try:
        host = (urlsplit(url if "//" in url else f"//{url}").hostname or "") if url else ""
    except ValueError:
        host = ""
    labels = host.strip(".").split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of each text, letters only, and row offsets."""
    points, ends = code_points(texts)
    low = np.where(points < 128, _FOLD[np.minimum(points, 127)], points)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    code = low.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = ((code[:-2] * np.uint64(0x1F123BB5) + code[1:-1]) * np.uint64(0x1F123BB5) + code[2:]) * np.uint64(0x9E3779B97F4A7C15)
    keep = (low[1:-1] != 32) & (np.diff(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), n=1)[:-1] == 0)
    keep &= np.repeat(np.arange(len(ends) - 1), np.diff(ends))[1:-1] == np.repeat(np.arange(len(ends) - 1), np.diff(ends))[2:]
    kept = np.concatenate([[0, 0], np.cumsum(keep)])
    kept = np.append(kept, kept[-1]) if len(kept) < len(points) + 1 else kept
    return (mixed[keep] >> np.uint64(49)).astype(np.int64), kept[ends]


@dataclass(frozen=True)
class TextModel:
    """Log probability of each trigram bucket in each language: a bounded table."""

    languages: list[str]
    table: np.ndarray  # languages x BUCKETS
    middle: np.ndarray  # of the mean log likelihoods of a language's documents
    limit: np.ndarray  # largest shortfall of a text of the language

    def foreign(self, told: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Whether each text is too unlikely for its language ``lang``; a text without trigrams is not."""
        strong = np.minimum(n, STRONG_TRIGRAMS)
        mean = told[np.arange(len(n)), lang] / (SHARE * np.maximum(strong, 1))
        return (n > 0) & (shortfall(self.middle[lang], mean, strong) > self.limit[lang])

    def log_likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihood of each text in each language, and its number of trigrams."""
        found, ends = trigrams(texts)
        n = np.diff(ends)
        weight = SHARE * np.minimum(n, STRONG_TRIGRAMS) / np.maximum(n, 1)
        out = np.zeros((len(n), len(self.languages)))
        for i, row in enumerate(self.table):
            out[:, i] = arrays.segment_sums(row[found], ends) * weight
        return out, n


def shortfall(middle, mean, n):
    """How far a mean over ``n`` trigrams lies below the middle, less for a short text."""
    return (middle - mean) * np.sqrt(np.minimum(n, STRONG_TRIGRAMS) / STRONG_TRIGRAMS)


def _quantiles(rows: DataFrame, value: Column, share: float) -> DataFrame:
    """``(language, q)``: exact quantile of each language, cut into ranges of the value."""
    valued = rows.select("language", value.alias("value"))
    dist = valued.groupBy("language", "value").agg(F.count("*").alias("n"))
    return quantile_points(dist, ["language"], [share], plan_buckets(valued, "value")).select("language", "q")


def calibrate(chosen: DataFrame, names: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``middle`` and ``limit`` of each language from all its documents, each scored with its
    own trigrams left out of the counts. A document likelier in another language is mislabelled
    and does not count; a language without documents has no limit."""
    types = common.schema("language int, n long, mean double")
    total = table.sum(1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        place = {x: i for i, x in enumerate(names)}
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                found, ends = trigrams(arrays.plain_texts(part.column("_text")))
                n = np.diff(ends)
                lang = np.array([place[x] for x in part.column("_lang").to_pylist()], np.int64)
                _, at, own = np.unique(arrays.segment_ids(ends) * BUCKETS + found, return_inverse=True, return_counts=True)
                left = table[np.repeat(lang, n), found] - own[at.ravel()]
                mean = arrays.segment_sums(np.log(left), ends) / np.maximum(n, 1) - np.log(total[lang] - n)
                other = np.full(len(n), -np.inf)
                for i, row in enumerate(table):
                    told = arrays.segment_sums(np.log(row / total[i])[found], ends) / np.maximum(n, 1)
                    other = np.where(lang == i, other, np.maximum(other, told))
                at = (n > 0) & (mean >= other)
                yield common.arrow_out({"language": lang[at].astype(np.int32), "n": n[at], "mean": mean[at]}, types)

    scored = common.cut_lineage(chosen.mapInArrow(score, types))
    middles = _quantiles(scored, F.col("mean"), 0.5).withColumnRenamed("q", "middle")  # one row a language
    strong = F.least(F.col("n"), F.lit(STRONG_TRIGRAMS)) / STRONG_TRIGRAMS
    short = (F.col("middle") - F.col("mean")) * F.sqrt(strong)
    middles = common.cut_lineage(middles)
    own = _quantiles(scored.join(F.broadcast(middles), "language"), short, OWN_SHARE).withColumnRenamed("q", "own")
    found = middles.join(own, "language").collect()
    middle, limit = np.zeros(len(names)), np.full(len(names), np.inf)
    for r in found:
        middle[r["language"]] = r["middle"]
        uniform = r["middle"] + np.log(BUCKETS)  # the shortfall of a long text of uniform trigrams
        limit[r["language"]] = max(r["own"], (r["own"] + uniform) / 2)
    return middle, limit


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> TextModel:
    """Text model from all labelled documents of at most ``MOST_LANGUAGES`` languages, each taken whole."""
    labelled = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.col(key).cast("long").alias("_key")).where("_lang is not null and _text is not null")
    n = labelled.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MOST_LANGUAGES).collect()
    names = sorted(r["_lang"] for r in n)
    if not names:
        return TextModel([], np.zeros((0, BUCKETS)), np.zeros(0), np.zeros(0))
    chosen = labelled.where(F.col("_lang").isin(names))
    types = common.schema("language int, bucket int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        place = {x: i for i, x in enumerate(names)}
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                found, ends = trigrams(arrays.plain_texts(part.column("_text")))
                row = np.repeat([place[x] for x in part.column("_lang").to_pylist()], np.diff(ends))
                cells, n = np.unique(row * BUCKETS + found, return_counts=True)
                yield common.arrow_out({"language": (cells // BUCKETS).astype(np.int32), "bucket": (cells % BUCKETS).astype(np.int32), "n": n}, types)

    cells = chosen.mapInArrow(count, types).groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS at most
    table = np.full((len(names), BUCKETS), 0.5)
    np.add.at(table, (cells["language"].to_numpy(), cells["bucket"].to_numpy()), cells["n"].to_numpy())
    return TextModel(names, np.log(table / table.sum(1, keepdims=True)), *calibrate(chosen, names, table))


def evidence(df: DataFrame, model: TextModel, key: str, text: str, url: str | None, declared: str | None, html: bool) -> DataFrame:
    """Per row: key, host, domain, suffix, declared value, trigrams and the text's own log
    likelihoods and posterior. With ``html`` the text and the declared value come from markup."""
    columns = [F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")]
    columns += [F.col(c).cast("string").alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((url, "_url"), (declared, "_declared"))]
    types = common.schema("_key long, _row long, host string, domain string, suffix string, declared string, trigrams long, told array<double>, posterior array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.forget()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in arrays.slices(batch, "_text", SLICE):
                texts, said = arrays.plain_texts(part.column("_text")), part.column("_declared").to_pylist()
                if html:
                    pages = texts.to_pylist()
                    said = [declared_language(p) or s for p, s in zip(pages, said, strict=True)]
                    texts = pa.array([visible_text(p) for p in pages], pa.large_string())
                told, n = model.log_likelihoods(texts)
                likely = np.exp(told - told.max(1, keepdims=True)) if told.size else told
                likely /= np.maximum(likely.sum(1, keepdims=True), 1e-300)
                if told.size:  # a text in none of the languages says nothing about its host or declaration
                    likely[model.foreign(told, n, told.argmax(1))] = 0.0
                hosts = [host_parts(u) for u in part.column("_url").to_pylist()]
                lists = {c: pa.array(v.tolist(), pa.list_(pa.float64())) for c, v in (("told", told), ("posterior", likely))}
                names = {c: [h[i] for h in hosts] for i, c in enumerate(("host", "domain", "suffix"))}
                clean = [s.strip().lower().replace("_", "-").split("-")[0] if s else "" for s in said]
                yield common.arrow_out({"_key": part.column("_key"), "_row": np.arange(row, row + part.num_rows), "declared": clean, "trigrams": n} | names | lists, types)
                row += part.num_rows

    return df.select(*columns).mapInArrow(run, types)


def _sums(n: int, column: str = "posterior") -> list:
    return [F.sum(F.col(column)[i]).alias(f"n{i}") for i in range(n)]


def identify(df: DataFrame, model: TextModel, key: str, text: str, url: str | None = None, declared: str | None = None, html: bool = False) -> DataFrame:
    """One row for each row of ``df``: key, ``lang``, ``posterior``, ``text_lang``, ``declared``, ``host``, ``kept``.

    ``lang`` has the largest posterior; ties go to the first name. ``kept`` tells that the posterior
    reaches ``LEAST_POSTERIOR`` and that the text is not too unlikely for ``lang``, as one in none of
    the labelled languages is; ``text_lang`` is null if it is too unlikely for each. A null or empty text says nothing, so the other evidence decides;
    a null or broken address has the empty host, and a missing declaration counts as a value of its
    own. Without labelled languages every ``lang`` is null and nothing is kept. Repeated rows and
    null keys are judged row by row; other columns are ignored; an empty table gives an empty
    result.
    """
    n, names = len(model.languages), list(model.languages)
    rows = common.cut_lineage(evidence(df, model, key, text, url, declared, html))
    if not n:
        return rows.select(F.col("_key").alias(key), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", F.lit(False).alias("kept"))
    said = rows.where("trigrams > 0")
    whole = rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.when(F.col("trigrams") > 0, F.col("posterior")[i])), F.lit(0.0)).alias(f"n{i}") for i in range(n)]).first()
    overall = np.array([whole[f"n{i}"] for i in range(n)]) + 1.0
    total = overall.sum()
    overall = overall / total

    counts = F.array(*[F.col(f"n{i}") for i in range(n)])
    hosts = common.cut_lineage(rows.groupBy("host", "domain").agg(F.count("*").alias("rows"), *[F.sum(F.when(F.col("trigrams") > 0, F.col("posterior")[i]).otherwise(0.0)).alias(f"n{i}") for i in range(n)]))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]).select("domain", counts.alias("of_domain"))
    hosts = hosts.select("host", "domain", "rows", counts.alias("of_host")).join(common.cut_lineage(domains), "domain").drop("domain")
    # A host above the share is one of at most 1 / share.
    placed = hot_split_join(rows, common.cut_lineage(hosts), ["host"], F.col("rows") > HOT_HOST * whole["rows"], int(1 / HOT_HOST), "_row", always=True)
    for column in ("suffix", "declared"):
        table = said.groupBy(column).agg(*_sums(n)).select(column, counts.alias(f"of_{column}"))
        placed = placed.join(broadcast_if_small(common.cut_lineage(table)), column, "left")
    types = common.schema("_key long, host string, declared string, lang string, posterior double, text_lang string, kept boolean")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(column: pa.Array) -> np.ndarray:
            return np.array([x or [0.0] * n for x in column.to_pylist()], float).reshape(-1, n)

        for batch in batches:
            told, own = matrix(batch.column("told")), matrix(batch.column("posterior"))
            seen = np.asarray(batch.column("trigrams")) > 0
            own *= seen[:, None]  # what this row itself has added
            host, domain = matrix(batch.column("of_host")), matrix(batch.column("of_domain"))
            without = lambda x: np.maximum(x - own, 0)
            above = without(domain) + HOST_WEIGHT * overall
            above /= above.sum(1, keepdims=True)
            prior = without(host) + HOST_WEIGHT * above
            score = told + np.log(prior / prior.sum(1, keepdims=True))
            for column, weight in (("suffix", SUFFIX_WEIGHT), ("declared", DECLARED_WEIGHT)):
                counted = without(matrix(batch.column(f"of_{column}")))
                value = batch.column(column).to_pylist()
                expected = np.array([[(0.9 if v == x else 0.1 / max(n - 1, 1)) if v in names else overall[i] for i, x in enumerate(names)] for v in value]).reshape(-1, n)
                share = (counted + weight * expected) / (counted.sum(1, keepdims=True) + weight)  # P(language | value)
                score += np.log(share / overall)  # the value's likelihood up to a factor of its own
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            best, text_best = p.argmax(1), told.argmax(1)
            counts_of = np.asarray(batch.column("trigrams"))
            known = ~model.foreign(told, counts_of, best)
            seen &= ~model.foreign(told, counts_of, text_best)
            out = {"_key": batch.column("_key"), "host": batch.column("host"), "declared": batch.column("declared"), "lang": [names[i] for i in best], "posterior": p.max(1)}
            yield common.arrow_out(out | {"text_lang": [names[i] if s else None for i, s in zip(text_best, seen, strict=True)], "kept": (p.max(1) >= LEAST_POSTERIOR) & known}, types)

    wanted = ["_key", "host", "suffix", "declared", "trigrams", "told", "posterior", "of_host", "of_domain", "of_suffix", "of_declared"]
    out = placed.select(*wanted).mapInArrow(fuse, types)
    return out.select(F.col("_key").alias(key), "lang", "posterior", "text_lang", F.when(F.col("declared") != "", F.col("declared")).alias("declared"), F.when(F.col("host") != "", F.col("host")).alias("host"), "kept")


def keep_identified(df: DataFrame, model: TextModel, key: str = "doc_id", text: str = "text", declared: str | None = "lang", source: str | None = "source") -> DataFrame:
    """``df`` without the rows whose language stays uncertain or is none of the labelled ones; rows of one key go or stay together.
    The source of a document stands for its host."""
    return common.without(df, key, identify(df, model, key, text, source, declared).where("not kept").select(key))
