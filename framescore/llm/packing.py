"""Best-fit decreasing packing with a segment tree over remaining capacities.

A document is its ids and a closing id; only one longer than ``capacity`` is cut.  Pieces of
one length are interchangeable, so the packing itself needs the count of each length alone,
``capacity`` numbers however many documents there are.  Lengths go in from the longest;
the segment tree, over the remaining capacities with the open bins that have each, finds
the tightest bin that fits in logarithmic time; what is true of one bin of a class is done
for all bins of it at once.  The result is a list of *runs*: the pieces of a length numbered
i to j go, k a bin, to consecutive bins at an offset.  Pieces are numbered within their length
by a hash bucket and a row number in it, so that no length gathers in one task.

A null or empty text is a document of the closing id alone.  Repeated rows are packed
each for itself.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks as C
from .bpe import _slices, tokenizer, word_bpe_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length in a bucket, on average at most.
BUCKET_ROWS = 50_000


class Tightest:
    """Segment tree over capacities 0 to n - 1: is any bin open with so much left?"""

    def __init__(self, n: int):
        self.size = 1 << (n - 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def at_least(self, i: int) -> int | None:
        """The smallest capacity of i or more that has an open bin."""
        i += self.size
        if self.any[i]:
            return i - self.size
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, end, first bin, pieces a bin, offset) for so many pieces of each length."""
    tree, open_bins, runs, bins = Tightest(capacity + 1), [deque() for _ in range(capacity + 1)], [], 0
    for length in sorted(counts, reverse=True):
        todo, at = counts[length], 0
        while todo:
            left = tree.at_least(length)
            if left is None:
                first, n, left = bins, math.ceil(todo / (capacity // length)), capacity
                bins += n
            else:
                first, n = open_bins[left].popleft()
            each = min(left // length, todo)
            used = min(n, todo // each)
            runs.append((length, at, at + used * each, first, each, capacity - left))
            todo, at = todo - used * each, at + used * each
            rest = left - each * length
            # bins this class hasn't used keep what they have left; new ones are filled from the first
            for room, start, m in ((rest, first, used), (left, first + used, n - used)):
                if m and room:
                    open_bins[room].append((start, m))
                    tree.set(room, True)
            if left <= capacity and not open_bins[left]:
                tree.set(left, False)
    return runs


def pieces(docs: DataFrame, path: str, capacity: int, closing: int, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """The pieces of each document with the CRC-32 of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, step = tokenizer(path), closing.to_bytes(4, "little"), 4 * capacity
        for whole in batches:
            for batch in _slices(whole, col):
                rows = []
                for doc, ids in zip(batch.column(id_col).to_pylist(), bpe.encode([t or "" for t in batch.column(col).to_pylist()]), strict=True):
                    ids += end
                    rows += [(doc, i // step, i // 4, len(part := ids[i : i + step]) // 4, zlib.crc32(part)) for i in range(0, len(ids), step)]
                cols = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], PIECES.replace(" long", "").replace(" int", "").split(", "))

    return docs.select(F.col(id_col).cast("long").alias(id_col), col).mapInArrow(run, PIECES.replace("doc_id", f"`{id_col}`", 1))


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and ``length``; sequences are gapless."""
    found = C.checkpoint(found)
    n = found.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("number", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    runs = sorted(best_fit(by_length, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (length, first number) as one sorted key
        key = (table[:, 0] << 40) + table[:, 1]
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            run = table[np.searchsorted(key, (length << 40) + number, "right") - 1]
            i = number - run[:, 1]
            cols = {c: b.column(c) for c in names}
            cols |= {"sequence_id": pa.array(run[:, 3] + i // run[:, 4]), "offset": pa.array(run[:, 5] + i % run[:, 4] * length)}
            yield pa.RecordBatch.from_pydict(cols)

    names = found.columns
    schema = ", ".join([*(f"`{k}` {v}" for k, v in found.dtypes), "sequence_id long", "offset long"])
    return ranked.select(*names, (F.col("number") + F.col("base")).alias("number")).mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = 4096, closing: int = 1) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens."""
    return pack(pieces(docs, path or word_bpe_path(), capacity, closing), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
