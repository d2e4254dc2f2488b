"""Spelling variants: words one edit apart, found with the nodes of two tries.

The words are sorted and their trie is walked part by part, which numbers its nodes: every prefix
of a word is one integer. The same over reversed words numbers the suffixes. A word with the
position i skipped is the pair (node of the prefix before i, node of the suffix after i), and a
word with a character inserted at i is the pair (node before i, node from i on). Two words differ
by one replaced character exactly if they share a skipped pair, and by one inserted or deleted
character exactly if an inserted pair of one is a skipped pair of the other. An equi-join on two
integers thus gives all neighbours, and nothing else.

A pair determines everything but the skipped character, so no more words share a pair than the
alphabet has characters: no group grows with the corpus. Parts are cut at sampled words; only the
prefixes of these can lie in two parts, and they have numbers of their own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import common
from siftmill.plans.sizing import broadcast_if_small

#: Letters of a word: ASCII, and the upper half of Latin-1 from its first letter on.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a part of a trie, sampled words for each cut, and parts; a part is streamed.
PART_WORDS, SAMPLED, MOST_PARTS = 40_000, 50, 4_096
#: A form is at least so many times as frequent as its variant.
TIMES = 10


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 7, least_n: int = 2, slips: int | None = None) -> DataFrame:
    """``word``, ``n``: how often each run of letters occurs in all texts, A-Z lower-cased.

    With ``slips`` one run in so many of a row loses a character, by the crc32 of the key, a colon
    and the run: misspellings to measure with. Null texts hold no words; a null key is written as
    nothing. Words of fewer than ``least_chars`` characters or ``least_n`` occurrences are left out.
    """
    # A run can only lose characters, so shorter ones never become words.
    runs = F.filter(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)), lambda x: F.length(x) >= least_chars)
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(runs).alias("word")).withColumn("word", F.translate("word", UPPER, LOWER))
    if slips:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "_key", "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        rows = rows.withColumn("word", F.when(F.col("h") % slips == 0, cut).otherwise(F.col("word"))).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def cuts(words: DataFrame, column: str, n: int) -> list[str]:
    """Sorted words that cut the table into about ``n`` / ``PART_WORDS`` parts, from a sample by hash."""
    parts = min(MOST_PARTS, -(-n // PART_WORDS))
    if parts <= 1:
        return []
    share = max(1, n // (parts * SAMPLED))
    drawn = sorted(r[0] for r in words.where(F.pmod(F.xxhash64(column), F.lit(share)) == 0).select(column).collect())
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def number_nodes(words: DataFrame, column: str, bounds: list[str], nodes: str, place: str | None = None) -> DataFrame:
    """``words`` with the trie nodes of all prefixes of ``column``, the empty one first, and with the
    word's ``place`` in code-point order. The words are different and not null."""
    shared = {p: -i for i, p in enumerate(sorted({b[:k] for b in bounds for k in range(len(b) + 1)} | {""}))}
    types = common.schema(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema] + [f"{nodes} array<bigint>"] + ([f"{place} bigint"] if place else [])))
    dealt_types = common.schema(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema] + ["_part int"]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_right(bounds, w) for w in batch.column(column).to_pylist()]
            yield common.arrow_out({c: batch.column(c) for c in batch.schema.names} | {"_part": part}, dealt_types)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, path, made, row = -1, "", [0], 0, 0
        for batch in batches:
            flat, ends, places = [], [0], []
            for word, its in zip(batch.column(column).to_pylist(), batch.column("_part").to_pylist(), strict=True):
                if its != part:
                    part, last, path, made, row = its, "", [0], its << 40, its << 40
                same = 0
                for x, y in zip(last, word, strict=False):
                    if x != y:
                        break
                    same += 1
                del path[same + 1 :]
                for k in range(same + 1, len(word) + 1):
                    known = shared.get(word[:k]) if path[-1] <= 0 else None  # only below a shared prefix
                    made += known is None
                    path.append(made if known is None else known)
                flat += path
                ends.append(len(flat))
                places.append(row)
                last, row = word, row + 1
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield common.arrow_out({c: batch.column(c) for c in batch.schema.names} | {nodes: lists} | ({place: places} if place else {}), types)

    dealt = words.mapInArrow(deal, dealt_types)
    dealt = dealt.repartition(len(bounds) + 1, "_part") if bounds else dealt.coalesce(1)
    return dealt.sortWithinPartitions("_part", column).mapInArrow(walk, types)


def neighbours(words: DataFrame) -> DataFrame:
    """``place``, ``n``, ``other``, ``other_n``: each word with each word one edit away.

    ``words`` has ``place``, ``n``, ``word`` and the nodes ``p`` of its prefixes and ``s`` of its
    suffixes, shortest first. Skipping any of some equal neighbouring characters gives the same
    word; for insertions only the last of them counts, so every pair of words comes once.
    """
    skipped = "inline(transform(sequence(1, length(word)), i -> struct(p[i - 1] AS p, s[length(word) - i] AS s, substring(word, i, 1) <> substring(word, i + 1, 1) AS last)))"
    inserted = "inline(transform(sequence(0, length(word)), i -> struct(p[i] AS p, s[length(word) - i] AS s)))"
    skips = words.selectExpr("place", "n", skipped)
    asking = skips.select("p", "s", "place", "n", F.lit(False).alias("longer")).unionByName(words.selectExpr("place", "n", inserted).withColumn("longer", F.lit(True)))
    found = skips.select("p", "s", F.col("place").alias("other"), F.col("n").alias("other_n"), "last")
    met = asking.join(found, ["p", "s"]).where("CASE WHEN longer THEN last ELSE place <> other END")
    there = F.struct("place", "n", "other", "other_n")
    back = F.struct(F.col("other").alias("place"), F.col("other_n").alias("n"), F.col("place").alias("other"), F.col("n").alias("other_n"))
    return met.select(F.explode(F.when(F.col("longer"), F.array(there, back)).otherwise(F.array(there))).alias("x")).select("x.*")


def last_forms(forms: DataFrame) -> DataFrame:
    """``place``, ``root``: where the chain from each variant ends. Its reach doubles each round; a
    form is ``TIMES`` as frequent, so chains are short and have no cycle."""
    jumps = common.cut_lineage(forms.select("place", F.col("form").alias("root")))
    while True:
        further = broadcast_if_small(jumps.select(F.col("place").alias("root"), F.col("root").alias("_next")))
        moved = common.cut_lineage(jumps.join(further, "root", "left").select("place", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("place", "root")
        jumps = moved.select("place", "root")


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """One row for each of ``counts``' words: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the most frequent of the words one edit away (ties: the smallest in code-point
    order) if it is ``times`` as frequent, else null, and then ``root`` is the word itself. A word
    without neighbours has ``n_near`` 0. ``counts`` has different words with their counts; null and
    empty words are left out, other columns are ignored, and an empty table gives an empty result.
    """
    plain = common.cut_lineage(counts.select(F.col("word"), F.col("n").cast("long").alias("n")).where("word <> ''"))
    n = plain.count()
    ahead = number_nodes(plain, "word", cuts(plain, "word", n), "p", "place")
    turned = common.cut_lineage(ahead.withColumn("turned", F.reverse("word")))
    words = common.cut_lineage(number_nodes(turned, "turned", cuts(turned, "turned", n), "s").drop("turned"))
    nearest: Column = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("place")))
    near = common.cut_lineage(neighbours(words).groupBy("place", "n").agg(F.count("*").alias("n_near"), nearest.alias("best")))
    chosen = near.where(-F.col("best.n") >= times * F.col("n")).select("place", F.col("best.place").alias("form"), (-F.col("best.n")).alias("form_n"))
    chosen = common.cut_lineage(chosen)
    names = words.select("place", "word")
    ends = last_forms(chosen).join(names.toDF("root", "root_word"), "root").select("place", F.col("root_word").alias("root"))
    named = chosen.join(names.toDF("form", "form_word"), "form").select("place", F.col("form_word").alias("form"), "form_n").join(ends, "place")
    out = words.select("place", "word", "n").join(near.select("place", "n_near"), "place", "left").join(named, "place", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
