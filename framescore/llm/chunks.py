"""Chunks of a corpus and a census of hashed keys between them.

Every document belongs to one *chunk*, a bounded group that is dealt out by a hash of its
id.  A chunk turns its texts into 64-bit keys, sends each distinct key once (with a
bit that says "more than once here") and gets back one bit for each: does this key occur
more than once in the whole corpus?  So a key that a third of all rows share costs one
entry a chunk, never a row a document, and the texts are shuffled only once: the plans
read the exchange by ``chunk`` again (``ReusedExchange``).
"""

from __future__ import annotations

import functools
import math
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Bytes of text in one chunk and of keys in one bucket of the census, on average.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INV1 = np.uint64(pow(int(_M1), -1, 1 << 64))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts; one aggregate over the column."""
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def shared_dir(spark) -> str:
    """The folder all executors share.  Only a session on this machine alone may have none: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")

        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpoint(df: DataFrame, **measures: Column) -> DataFrame:
    """The rows, written once as a table in the shared folder and read from there; the lineage ends there.

    Aggregates given by name are found while the rows are written, without jobs of their own, and are in ``measured`` of what is returned.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    (df.observe(seen, *(c.alias(k) for k, c in measures.items())) if seen else df).write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written, found.measured = path, seen.get if seen else {}
    return found


def discard(df: DataFrame) -> None:
    """Deletes a table that ``checkpoint`` wrote and nothing reads any more."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def slices(batch: pa.RecordBatch, most: int, col: str = "text"):
    """The rows of a batch, as many at a time as have ``most`` bytes of text together, one at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


#: Keys that are broadcast by ``heavy_join`` at most; rows that a task takes of one key without any harm.
HEAVY, LIGHT = 1000, 1000


def is_light(most: int, total: int) -> bool:
    """Whether a key with ``most`` of ``total`` rows has too few of them to fill a task."""
    return most <= max(LIGHT, total / HEAVY)


def heavy_join(rows: DataFrame, one: DataFrame, keys: list[str], count: str, total: int | None = None, most: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has a row for each of their keys and in ``count`` how many of ``rows`` have it.

    A key with more than a ``HEAVY``-th of all rows, so one of ``HEAVY`` at most, and more than ``LIGHT`` is broadcast, and its rows
    stay where they are; all others have too few rows to fill a task.  Where there is no such key it is a plain join: each
    broadcast costs the driver a thread, a job and a plan of its own.  So does counting, which is left out where ``total`` and ``most``,
    the rows of all keys and of one key at most, are known, or ``most`` alone is small enough.
    """
    if most is None or most > LIGHT and total is None:
        most, all_rows = (x or 0 for x in one.agg(F.max(count), F.sum(count)).first())
        total = all_rows if total is None else total
    if is_light(most, total or 0):
        return rows.join(one, keys)
    bar = max(LIGHT, total / HEAVY)
    heavy = checkpoint(one.where(F.col(count) > bar))
    there = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(one.where(F.col(count) <= bar), keys)
    return there.unionByName(rest)


def chunked(docs: DataFrame, n_chunks: int, id_col: str = "doc_id", col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``col``, ``keep`` and the chunk of each row, by id and text: only rows with both equal share one for sure."""
    key = F.xxhash64(id_col, col)
    return docs.select(F.col(id_col), F.col(col), *keep, F.pmod(key, F.lit(n_chunks)).cast("int").alias("chunk"))


def sizes(total_bytes: int, key_bytes: float) -> tuple[int, int]:
    """Chunks for so many bytes of text and buckets for ``key_bytes`` of keys a byte of text."""
    n = max(1, math.ceil(total_bytes / CHUNK_BYTES))
    return n, max(min(n, 12), math.ceil(total_bytes * key_bytes / BUCKET_BYTES))


def buffers(table: pa.Table, col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column, end to end, and the n + 1 offsets of its rows (null: empty)."""
    arr = pc.fill_null(table.column(col), "").cast(pa.large_string()).combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _M2)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _M1), ("i", _INV1)):
            v = np.full(size, base, np.uint64)
            v[0] = 1
            _POWERS[name] = np.multiply.accumulate(v)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of data[i:j] times base**i."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * p, out=out[1:])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p = prefix_hash(data)
    _, inv = powers(len(data) + 1)
    return mix((p[ends] - p[starts]) * inv[starts]), np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, batch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` of all rows, and the n + 1 offsets of the rows among them."""
    hashes, counts, i, n = [], [np.zeros(1, np.int64)], 0, len(off) - 1
    done = 0
    while i < n:  # a batch of rows at a time, so that what it makes stays small
        j = max(i + 1, int(np.searchsorted(off, off[i] + batch, "right")) - 1)
        h, w = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        hashes.append(h)
        counts.append(w[1:] + done)
        done += len(h)
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(counts).astype(np.int64)


def rolled(h: np.ndarray, k: int, base: np.uint64 = _M2) -> np.ndarray:
    """Hash of every k consecutive values: len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, level, width = None, 0, h, 1
    power = lambda e: np.uint64(pow(int(base), e, 1 << 64))
    while True:
        if k & width:
            part = level[have : have + n]
            out = part.copy() if out is None else out * power(width) + part
            have += width
        if 2 * width > k:
            return mix(out)
        level = level[:-width] * power(width) + level[width:]
        width *= 2


def distinct(keys: np.ndarray, more: np.ndarray | None = None):
    """Sorted distinct keys (by ``more`` too, if given), whether each occurs twice here, and each key's place."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    at = np.flatnonzero(new)
    twice = np.diff(np.append(at, len(k))) > 1
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[at], None if more is None else m[at], twice, place


CENSUS = "chunk int, bucket int, keys binary, more binary, twice binary"
REPLY = "chunk int, bucket int, bits binary"


def spread(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall in, and where each one's keys begin, with their number at the end: as many as there are keys at most."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return of[starts].astype(np.int64), np.append(starts, len(keys))


def census_rows(chunk: int, keys: np.ndarray, more: np.ndarray | None, twice: np.ndarray, buckets: int) -> pa.Table:
    """A chunk's distinct keys as one row for each bucket that they fall in, however many buckets there are."""
    found, cut = spread(keys, buckets)
    rows = []
    for b, i, j in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        rows.append((chunk, b, keys[i:j].tobytes(), b"" if more is None else more[i:j].tobytes(), np.packbits(twice[i:j]).tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("chunk", "bucket", "keys", "more", "twice"), cols, types, strict=True)})


def _count(table: pa.Table) -> pa.Table:
    parts = table.column("keys").to_pylist()
    n = np.array([len(p) // 8 for p in parts])
    keys = np.frombuffer(b"".join(parts), np.uint64)
    raw = b"".join(table.column("more").to_pylist())
    more = np.frombuffer(raw, np.uint32) if raw else None
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=c) for t, c in zip(table.column("twice").to_pylist(), n, strict=True)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if more is not None and bool(np.any(same & (more[order][1:] != more[order][:-1]))):
        order = np.lexsort((more, keys))
        same = keys[order][1:] == keys[order][:-1]
    if more is not None:
        same &= more[order][1:] == more[order][:-1]
    hit = twice[order]
    hit[1:] |= same
    hit[:-1] |= same
    # a key that one chunk has twice is repeated for that chunk alone: no other has it
    out = np.empty(len(keys), bool)
    out[order] = hit
    bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(n)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def census(rows: DataFrame) -> DataFrame:
    """For each row of ``census_rows``, a bit for each of its keys: more than one in all chunks?"""
    return rows.groupBy("bucket").applyInArrow(_count, REPLY)


def _first(table: pa.Table) -> pa.Table:
    parts = table.column("keys").to_pylist()
    n = np.array([len(x) // 8 for x in parts])
    keys, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("keys", "more"))
    order = np.lexsort((np.repeat(table.column("chunk").to_numpy(), n), more, keys))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    out = np.empty(len(keys), bool)
    out[order] = new
    bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(n)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def first_census(rows: DataFrame) -> DataFrame:
    """For each row of ``census_rows`` (``more`` of 64 bits), a bit for each of its keys: is this chunk the first to have it?"""
    return rows.groupBy("bucket").applyInArrow(_first, REPLY)


def replied(reply: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of a chunk's distinct keys, in their order."""
    (found, cut), out = spread(keys, buckets), np.zeros(len(keys), bool)
    at = np.searchsorted(found, reply.column("bucket").to_numpy())
    for k, bits in zip(at.tolist(), reply.column("bits").to_pylist(), strict=True):
        out[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cut[k + 1] - cut[k]).astype(bool)
    return out


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Which places lie in [s, s + width) of a flagged start s."""
    n = len(starts)
    edge = np.zeros(n + width + 1, np.int32)
    edge[:n] += starts
    edge[width : n + width] -= starts
    return np.cumsum(edge[:n]) > 0


def left(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: its number within its row, and places from it to the row's end."""
    at = np.arange(off[-1])
    size = np.diff(off)
    return at - np.repeat(off[:-1], size), np.repeat(off[1:], size) - at
