"""Periodic runs of words: maximal stretches that repeat with a smallest period, found by Karp-Miller-Rosenberg names.

A stretch of consecutive words is a run of period q if words q apart are identical, q is the smallest such
number, the stretch has at least ``LEAST`` words and ``EXPONENT`` periods, and no neighbouring word goes on with
the period.  Documents are looked at one by one, so nothing is shuffled: a task names the words of a slice of
its rows, then windows of 2, 4, 8, ... words by the pair of names of their halves.  Names are equal only within
a document, and windows that stand there once have none, so each level is as small as what repeats.  Two
windows' longest common extension to the right or left follows from the levels in descending order.

Candidates are points of a grid: where a run of period q stands, words q apart agree over a stretch of
max(LEAST - q, (EXPONENT - 1) q) places at least, so one point in so many lies within, and is extended to both sides by
names.  No hash of words or windows and no sorted suffixes are involved, so nothing can collide.

Null and empty texts have no words and no runs.  A null id is kept; repeated rows count each.  Kept columns
may have any name; one that a result has too is left out.  A text has to fit a task's memory, some 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C

#: Words and periods that a run has at least.
LEAST, EXPONENT = 24, 3
#: Bytes of text that are looked at together; one longer text is a slice of its own.
SLICE = 1 << 20
RESULTS = ("n_words", "runs", "collapsed")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word ``[^\\x20\\x09-\\x0D]+`` as a number, the n + 1 offsets of the rows, and the words by number."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    off, flat = split.offsets.to_numpy().astype(np.int64), split.values
    flat = flat.slice(off[0], off[-1] - off[0]) if len(off) else flat
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), before[off - off[0]] if len(off) else np.zeros(1, np.int64), coded.dictionary


def _ranks(keys: np.ndarray) -> np.ndarray:
    """A name from 0 for each key that stands twice or more; -1 for others."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), np.int64)
    out[order] = np.where(same[1:] | same[:-1], np.cumsum(~same[:-1]) - 1, -1)
    return out


def names(words: np.ndarray, off: np.ndarray, levels: int) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words from each place, ``levels`` of them or until nothing repeats; -1 stands once or ends with the row."""
    n = len(words)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    named = np.full(n + 1, -1, np.int64)
    named[:n] = _ranks(row * (words.max(initial=0) + 1) + words)
    out, width = [named.astype(np.int32)], 1
    while len(out) < levels and (named >= 0).any():
        at = np.flatnonzero(named[: max(0, n + 1 - width)] >= 0)
        # the other half has a name in the same row only, as names of different rows differ
        at = at[(named[at + width] >= 0) & (row[at] == row[np.minimum(at + width, n - 1)])]
        pair = _ranks(named[at] * (named.max() + 1) + named[at + width])
        named = np.full(n + 1, -1, np.int64)
        named[at] = pair
        out.append(named.astype(np.int32))
        width *= 2
    return out if (named >= 0).any() else out[:-1]


def _right(level: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places from i on, one after another, that have the same word as the places q further."""
    at = i.copy()
    for k in range(len(level) - 1, -1, -1):
        a = level[k][at]
        at += np.where((a >= 0) & (a == level[k][at + q]), 1 << k, 0)
    return at - i


def _left(level: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places before i, back to back, that have the same word as the places q further."""
    at = i.copy()
    for k in range(len(level) - 1, -1, -1):
        before = np.maximum(at - (1 << k), 0)
        a = level[k][before]
        at -= np.where((at >= 1 << k) & (a >= 0) & (a == level[k][before + q]), 1 << k, 0)
    return i - at


def maximal_runs(words: np.ndarray, off: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """Row, start, length and period of each run of numbered words in rows from ``off[i]`` to ``off[i + 1]``, by row, start and period."""
    none = (np.zeros(0, np.int64),) * 4
    if len(words) < least:
        return none
    # one side of a grid point that a run has agrees over half of the grid's step, so such windows repeat in the row
    step = min(max(least - q, (exponent - 1) * q, 1) for q in range(1, least + 1))
    few = max(1, (step + 1) // 2).bit_length()
    screen = names(words, off, few)
    if len(screen) < few:
        return none
    size = np.diff(off)
    rows = np.unique(np.searchsorted(off, np.flatnonzero(screen[-1] >= 0), "right") - 1)
    rows = rows[np.argsort(-size[rows], kind="stable")]  # long ones first, so those that have room for a period lead
    n, base = size[rows], off[rows]
    start = np.concatenate([[0], np.cumsum(n)])
    words = words[np.repeat(base - start[:-1], n) + np.arange(start[-1])]
    level = names(words, start, int(n.max()).bit_length())
    at, period = [], []
    first = level[0]
    for q in range(1, int(n.max()) // exponent + 1):
        end = start[np.searchsorted(-n, -exponent * q, "right")]
        g = np.arange(0, end - q, max(least - q, (exponent - 1) * q, 1))
        a = first[g]
        g = g[(a >= 0) & (a == first[g + q])]
        if len(g):
            at.append(g)
            period.append(np.full(len(g), q))
    if not at:
        return none
    g, q = np.concatenate(at), np.concatenate(period)
    back = _left(level, g, q)
    s, length = g - back, back + _right(level, g, q) + q
    long = length >= np.maximum(least, exponent * q)
    s, length, q = s[long], length[long], q[long]
    # a stretch that several periods have, all multiples of the smallest
    order = np.lexsort((q, length, s))
    s, length, q = s[order], length[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (length[1:] != length[:-1])
    s, length, q = s[new], length[new], q[new]
    row = np.searchsorted(start, s, "right") - 1
    order = np.lexsort((q, s - start[row], rows[row]))
    row, s, length, q = row[order], s[order], length[order], q[order]
    return rows[row], s - start[row], length, q


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``keep``, ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed`` of each row.

    ``collapsed`` is the text without the words of runs that come after a run's first period, joined by one space.
    """
    keep = tuple(k for k in keep if k not in RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.slices(batch, SLICE):
                words, off, by_number = words_of(b.column("text"))
                row, start, length, period = maximal_runs(words, off, least, exponent)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, off[row] + start + period, 1)
                np.add.at(edge, off[row] + start + length, -1)
                stays = np.cumsum(edge[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stays)])[off]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), by_number.take(pa.array(words[stays]))), " ")
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(np.diff(off), pa.int64()), runs, kept], [*keep, *RESULTS])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in texts whose id's hash ends in 0, words from some place on repeat with some period."""
    held = docs.select("doc_id", "text", F.expr("crc32(CAST(doc_id AS string))").alias("h"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")
    held = held.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"g": F.expr("h div 10"), "n": F.expr("CAST(size(w) AS bigint)")})
    held = held.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = "concat_ws(' ', transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS int)])))"
    return held.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {tail} ELSE text END").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # of equal exponents the first stays: runs are sorted by start, then period
    best = F.expr("aggregate(runs, runs[0], (a, x) -> IF(x.length * a.period > a.length * x.period, x, a))")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr(f"sha2({lines}, 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
