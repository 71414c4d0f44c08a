"""Spelling variants: words that differ by one character, counted and ranked without ever making pairs.

Words get a rank in the order of their counts, largest first, equal counts in the order of code points, so the best of
many words is the one with the smallest rank.  Two words of one length that differ at one place share exactly one
*wildcard group*, that of (place, what stands before, what stands after).  A window over each group gives its size and its two
best words, so each member learns how many others there are and which is best, itself left out.  Words that differ by an
insertion meet where a word's deletions, each distinct one once, join the vocabulary: one of those is the shorter
word itself, which learns how many longer ones there are and the best of them, and each of these learns of the shorter one.

A word of m letters sends m + m + 1 keys and gets back at most as many rows, whatever its group's size; a group has at most
as many words as the alphabet has characters.  Keys are 96-bit hashes of what is left of a word, made from prefix sums, so long words cost
their length, not its square.  All keys go through one exchange.

Roots follow forms by doubling pointers; each form has ``ratio`` times the count of its variant, so chains are as short as
the logarithm of the largest count, and the number of rounds is known beforehand.

Null texts have no words; a null id counts as an empty one where ids matter.  Words with a null count or none at all are
left out; repeated words add up.  Only ``word`` and ``n`` are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks as C

#: Letters of words whose keys a task makes, about.
LETTERS = 1 << 20
#: How many times a word's count its form has at least.
RATIO = 10
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_HOLE, _DELETED, _OWN = 0, 1, 2


@functools.lru_cache(2)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.uint64]:
    """The first n powers of a base modulo 2**64, and the base's inverse."""
    v = np.full(n, _BASES[which], np.uint64)
    v[:1] = 1
    return np.multiply.accumulate(v), np.uint64(pow(int(_BASES[which]), -1, 1 << 64))


def _hashes(which: int, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of each with one character left open, and of each without one character."""
    size = np.diff(off)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(off[-1]) - off[word]
    power, inverse = _powers(which, 1 << int(size.max(initial=1)).bit_length())
    term = C.mix((codes + np.uint64(1 + which)) * _BASES[1 - which]) * power[at]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
    first, last = total[off[:-1]], total[off[1:]]
    own = last - first
    salt = C.mix((at.astype(np.uint64) + np.uint64(3)) * _BASES[which])
    open_ = own[word] - term + salt
    without = (total[:-1] - first[word]) + (last[word] - total[1:]) * inverse
    return C.mix(own), C.mix(open_), C.mix(without)


def keys_of(words: list[str], rank: np.ndarray) -> pa.RecordBatch:
    """Rows (a, b, kind, rank): each word with a place left open, without a character (each distinct rest once), and whole."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    off = np.cumsum([0, *map(len, words)])
    word = np.repeat(np.arange(len(words)), np.diff(off))
    # taking either of two equal neighbours away leaves the same
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    (own, open_, without), (own2, open2, without2) = (_hashes(i, codes, off) for i in (0, 1))
    a, b = np.concatenate([open_, without[new], own]), np.concatenate([open2, without2[new], own2])
    kind = np.repeat(np.array([_HOLE, _DELETED, _OWN], np.int8), [len(open_), int(new.sum()), len(own)])
    whose = np.concatenate([rank[word], rank[word[new]], rank])
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(kind), pa.array(whose)], ["a", "b", "kind", "rank"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, rank = batch.column("word").to_pylist(), batch.column("rank").to_numpy()
        i = 0
        while i < len(words):
            j, n = i, 0
            while j < len(words) and (j == i or n + len(words[j]) <= LETTERS // 4):
                n += len(words[j])
                j += 1
            yield keys_of(words[i:j], rank[i:j])
            i = j


def ranked(words: DataFrame) -> DataFrame:
    """``word``, ``n`` and ``rank``, which grows as counts fall and, of equal counts, with the word; written once, so that ranks stay."""
    counts = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    # ids of rows go up through the partitions of a sorted table
    return C.checkpoint(counts.orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()))


def near_words(vocabulary: DataFrame, letters: int) -> DataFrame:
    """Of words with ``rank``: ``n_near``, how many others differ by one character, and ``best``, the smallest rank of those; none without any."""
    parts = max(1, math.ceil(letters / LETTERS))
    keys = vocabulary.select("word", "rank").repartition(parts, "rank").mapInArrow(_keys, "a long, b int, kind byte, rank long")
    group = Window.partitionBy("a", "b")
    # the whole word last, so that the best two of a group are of those that were cut to it
    best = group.orderBy(F.col("kind") == _OWN, "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = keys.select(
        "kind",
        "rank",
        F.count("*").over(best).alias("size"),
        F.first("rank").over(best).alias("first"),
        F.nth_value("rank", 2).over(best).alias("second"),
        F.max(F.when(F.col("kind") == _OWN, F.col("rank"))).over(best).alias("own"),
    ).where("size > 1")
    is_a = lambda kind: F.col("kind") == kind
    # a group of a whole word holds no wildcards, as their hashes are salted by the place
    n = F.when(is_a(_DELETED), F.col("own").isNotNull().cast("long")).otherwise(F.col("size") - 1)
    other = F.when(is_a(_DELETED), F.col("own")).when(is_a(_HOLE) & (F.col("rank") == F.col("first")), F.col("second")).otherwise(F.col("first"))
    return met.select("rank", n.alias("n"), other.alias("best")).where("n > 0").groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(up: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """Of rows (rank, root), where ``root`` is the next word up, the last one up, for counts up to ``most``."""
    steps = math.floor(math.log(max(most, 1), ratio)) + 1  # each step up has ``ratio`` times the count, at least 1 at first
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        next_ = up.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        longer = C.checkpoint(up.join(next_, "root", "left").select("rank", F.coalesce("next", "root").alias("root")))
        C.discard(up)
        up = longer
    return up


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of rows (word, n), for each distinct word: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    ``form`` is the near word with the largest count if that is ``ratio`` times the word's own at least, else null;
    ``root`` is where forms of forms end, the word itself without a form.
    """
    if ratio < 2:
        raise ValueError("a form has to have at least twice the count")
    vocabulary = ranked(words)
    letters, most = vocabulary.agg(F.sum(F.char_length("word")), F.max("n")).first()
    upper = vocabulary.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = vocabulary.join(near_words(vocabulary, letters or 0), "rank", "left").join(upper, "best", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    found = C.checkpoint(found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(has, F.col(c)).alias(c) for c in ("best", "form", "form_n"))))
    C.discard(vocabulary)
    up = roots(C.checkpoint(found.where("best IS NOT NULL").select("rank", F.col("best").alias("root"))), most or 0, ratio)
    named = up.join(found.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return found.join(named, "rank", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(docs: DataFrame, shortest: int) -> DataFrame:
    """``doc_id`` and ``word`` for each maximal run of Latin letters with ``shortest`` characters at least, A to Z lower-cased."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    lower = F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(runs).alias("word")).select("doc_id", lower.alias("word"))


def one_dropped(runs: DataFrame) -> DataFrame:
    """``word`` of ``runs``, one in 31 of them, by a hash of id and word, without one of its characters."""
    held = runs.select("word", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word")).alias("h"))
    cut = "concat(substring(word, 1, CAST(h % char_length(word) AS int)), substring(word, CAST(h % char_length(word) AS int) + 2))"
    return held.select(F.expr(f"IF(h % 31 = 0, {cut}, word)").alias("word"))


#: Characters and occurrences that a word has at least.
SHORTEST, OCCURRENCES = 7, 2


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = one_dropped(letter_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHORTEST))
    words = runs.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)
    return spelling_variants(words)
