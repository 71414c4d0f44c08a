"""Substring dedup by difference-cover anchors over words.

A window is ``width`` consecutive words.  With a difference cover D of period v, any two places
s and t have a shift below v that brings both to positions of D modulo v.  So two equal windows
share an aligned anchor, ``width - v + 1`` words hashed at a position of D only.  Anchors that
occur once in the corpus rule out every window that has no other; the rest are extended to
whole windows, and those that occur twice cover the words to remove.

Nulls and empty texts have no words; rows are never merged, so repeated rows count as
documents of their own (and so repeat each other); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import chunks as C

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def difference_cover(v: int) -> list[int]:
    """A smallest set of residues whose differences reach every residue modulo v."""

    def search(chosen: list[int], size: int) -> list[int] | None:
        if len({(a - b) % v for a in chosen for b in chosen}) == v:
            return chosen
        if len(chosen) == size:
            return None
        return next((x for c in range(chosen[-1] + 1, v) if (x := search([*chosen, c], size))), None)

    return next(x for size in range(1, v + 1) if (x := search([0], size)))


def period(width: int) -> int:
    """The longest of some periods whose anchors keep over two fifths of the window."""
    return max([v for v in (1, 3, 7, 13, 21, 31, 57) if width - v + 1 >= 0.4 * width], default=1)


def anchors(words: np.ndarray, off: np.ndarray, width: int, v: int, cover: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a chunk."""
    k = width - v + 1
    at, rest = C.left(off)
    ok = np.isin(np.arange(v), cover)[at % v] & (rest >= k)
    places = np.flatnonzero(ok)
    return places, C.rolled(words, k)[places]


def _hits(words, off, width, v, cover, reply, buckets):
    """Starts of the windows that hold an anchor seen twice, with both their hashes."""
    places, keys = anchors(words, off, width, v, cover)
    uniq, _, _, place = C.distinct(keys)
    twice = C.replied(reply, uniq, buckets)[place]
    flag = np.zeros(len(words) + v + 1, np.int32)
    flag[places[twice]] = 1
    total = np.concatenate([[0], np.cumsum(flag)])
    _, rest = C.left(off)
    near = total[v : v + len(words)] - total[: len(words)] > 0
    starts = np.flatnonzero(near & (rest >= width))
    return starts, C.rolled(words, width)[starts], (C.rolled(words, width, C._M1)[starts] >> np.uint64(32)).astype(np.uint32)


def kept_text(text: bytes, gone: np.ndarray) -> bytes:
    words = text.split()
    return b" ".join([words[i] for i in np.flatnonzero(~gone)] if gone.any() else words)


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text``.

    A word goes if a window of ``width`` words that covers it starts anywhere else too, in
    the same document or another.
    """
    v = period(width)
    cover = difference_cover(v)
    n, buckets = C.sizes(C.text_bytes(docs), 0.35)
    chunked = C.chunked(docs.withColumnsRenamed({id_col: "doc_id"}), n)

    def first(table: pa.Table) -> pa.Table:
        words, off = C.word_hashes(*C.buffers(table))
        uniq, _, twice, _ = C.distinct(anchors(words, off, width, v, cover)[1])
        return C.census_rows(table.column("chunk")[0].as_py(), uniq, None, twice, buckets)

    def second(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.census_rows(0, np.zeros(0, np.uint64), None, np.zeros(0, bool), buckets)
        words, off = C.word_hashes(*C.buffers(table))
        _, a, b = _hits(words, off, width, v, cover, reply, buckets)
        uniq, more, twice, _ = C.distinct(a, b)
        return C.census_rows(table.column("chunk")[0].as_py(), uniq, more, twice, buckets)

    def last(table: pa.Table, reply: pa.Table, again: pa.Table) -> pa.Table:
        data, ends = C.buffers(table)
        words, off = C.word_hashes(data, ends)
        starts, a, b = _hits(words, off, width, v, cover, reply, buckets)
        uniq, _, _, place = C.distinct(a, b)
        flag = np.zeros(len(words), bool)
        flag[starts[C.replied(again, uniq, buckets)[place]]] = True
        gone = C.covered(flag, width)
        out = [kept_text(data[ends[i] : ends[i + 1]].tobytes(), gone[off[i] : off[i + 1]]) for i in range(table.num_rows)]
        total = np.concatenate([[0], np.cumsum(gone)])
        cols = {
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(np.diff(off), pa.int64()),
            "n_removed": pa.array(total[off[1:]] - total[off[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()),
        }
        if with_text:
            cols["kept_text"] = pa.array([x.decode() for x in out], pa.string())
        return pa.table(cols)

    one = C.census(chunked.groupBy("chunk").applyInArrow(first, C.CENSUS))
    two = C.census(chunked.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(second, C.CENSUS))
    replies = one.selectExpr("*", "1 AS phase").unionByName(two.selectExpr("*", "2 AS phase"))

    def end(table: pa.Table, reply: pa.Table) -> pa.Table:
        phase = reply.column("phase").to_numpy()
        return last(table, reply.filter(pa.array(phase == 1)), reply.filter(pa.array(phase == 2)))

    schema = RESULT + (", kept_text string" if with_text else "")
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(end, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
