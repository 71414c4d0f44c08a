"""Suffix-array dedup: repeated byte strings by induced sorting of shards.

Every string of ``width`` bytes has an anchor, the smallest hashed 16-byte gram in it, the
leftmost of equals, so equal strings have their anchor at the same place.  Strings next to each other
that share an anchor form a *segment*; it is split in two where the strings stop to reach as
far to its left, so that all strings of a segment share a long core, the segment's key.

A census of keys and whole segments finds segments that occur again as a whole (all
their strings do) and keys with several different segments.  One copy of each of the latter goes
to the shard of its key.  A shard's suffix array is built by induced sorting: suffixes are
classified, the leftmost-smaller substrings named, the string of names sorted recursively, and
all other suffixes are induced from their order, left to right and back.
Permuted common prefixes, in text order, then tell which strings start elsewhere too.

A key with more than ``HOT`` different segments (what stands before or after a passage that very many
documents share) would make a shard as large as their number: its strings are counted one by one in a
second census instead.

Null and empty texts have no bytes; repeated rows are documents of their own and so repeat each
other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import chunks as C

GRAM = 16
#: Bytes of all texts to one shard of segments, and different segments of a key that go to a shard at most.
SHARD_BYTES, HOT = 3 << 20, 2000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- suffix arrays ---


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one is."""
    step = np.sign(t[1:].astype(np.int32) - t[:-1])
    n = len(step)
    known = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(known[::-1])[::-1]  # the next place where neighbours differ
    return np.append(np.where(after < n, step[np.minimum(after, n - 1)] > 0, True), True)


def _ranks(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Dense ranks of numbers, or of pairs of ranks."""
    key = a if b is None else a * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(key, kind="stable")
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.append(0, k[1:] != k[:-1]))
    return out


def sorted_lms(t: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Places of the leftmost smaller suffixes in their order: their substrings are named, and the string of names is sorted recursively."""
    at = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(at):
        return at
    end = np.append(at[1:], len(t) - 1)
    bits = max(2, int(2 * t.max(initial=0) + 2).bit_length())
    each = max(1, 62 // bits)  # symbols of a substring that one number holds
    symbol = np.append(2 * t.astype(np.int64) + smaller, np.zeros(each, np.int64))
    name, i = None, 0
    while True:
        todo = np.arange(len(at)) if name is None else np.flatnonzero(at + i <= end)
        if not len(todo):
            break
        key = np.zeros(len(todo), np.int64)
        for j in range(each):
            p = at[todo] + i + j
            key = key << bits | np.where(p <= end[todo], symbol[np.minimum(p, len(symbol) - 1)] + 1, 0)
        if name is None:
            name = _ranks(key)
        else:
            more = np.zeros(len(at), np.int64)
            more[todo] = _ranks(key) + 1
            name = _ranks(name, more)
        i += each
    if int(name.max()) + 1 < len(at):
        return at[_suffixes_of_names(name)]
    return at[np.argsort(name, kind="stable")]


def _suffixes_of_names(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names, whose last symbol is 0 and stands nowhere else, by induced sorting in two scans."""
    smaller = suffix_types(t)
    lms = sorted_lms(t, smaller).tolist()
    size = np.bincount(t)
    ends = np.cumsum(size)
    names, small, out = t.tolist(), smaller.tolist(), [-1] * len(t)
    place = ends.tolist()
    for p in reversed(lms):
        place[names[p]] -= 1
        out[place[names[p]]] = p
    place = (ends - size).tolist()
    for i in range(len(out)):  # left to right: larger suffixes
        j = out[i] - 1
        if j >= 0 and not small[j]:
            c = names[j]
            out[place[c]] = j
            place[c] += 1
    place = ends.tolist()
    for i in range(len(out) - 1, -1, -1):  # and back: smaller ones
        j = out[i] - 1
        if j >= 0 and small[j]:
            c = names[j]
            place[c] -= 1
            out[place[c]] = j
    return np.array(out, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of ``t`` in their order, by induced sorting, a bucket at a time.

    The last symbol is 0, that before it isn't; other zeros are fine.
    """
    smaller = suffix_types(t)
    lms = sorted_lms(t, smaller)
    top = int(t.max(initial=0)) + 1
    lms_of = np.split(lms, np.cumsum(np.bincount(t[lms], minlength=top))[:-1])  # sorted, so by first symbol too
    large = _induced(t, ~smaller, lms_of, range(top), top, True)
    small = _induced(t, smaller, large, range(top - 1, -1, -1), top, False)
    return np.concatenate([x for c in range(top) for x in (large[c], small[c])])


def _induced(t: np.ndarray, kind: np.ndarray, given: list[np.ndarray], order: range, top: int, ahead: bool) -> list[np.ndarray]:
    """By first symbol, the suffixes of a kind, in order, from those given of the other kind.

    ``ahead``: larger-type suffixes from left to right; else smaller-type ones from right to left.
    """
    waiting: list[list[np.ndarray]] = [[] for _ in range(top)]
    out: list[np.ndarray] = [given[0][:0]] * top
    for c in order:
        # in the direction of the scan: what earlier buckets gave, then what those give within this bucket
        found = waiting[c]
        k, last = 0, not ahead and c == 0
        while k < len(found) or last:
            if k == len(found):  # 0 alone, the smallest suffix, comes last from the right
                found.append(np.array([len(t) - 1], given[0].dtype))
                last = False
            before = found[k] - 1
            before = before[before >= 0]
            before = before[kind[before] & (t[before] == c)]
            if len(before):
                found.append(before)
            k += 1
        mine = np.concatenate(found) if found else out[c]
        waiting[c] = []
        scan = np.concatenate([mine, given[c] if ahead else given[c][::-1]])
        before = scan - 1
        before = before[before >= 0]
        before = before[kind[before]]
        first = t[before]
        other = first > c if ahead else first < c
        before, first = before[other], first[other]
        if len(before):
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cut = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for i, j in zip(cut, [*cut[1:], len(first)], strict=True):
                waiting[int(first[i])].append(before[i:j])
        out[c] = mine if ahead else mine[::-1]
    return out


def permuted_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the suffix before each one in ``order`` (-1: none), and their common prefix.

    A suffix has one less than that of the place before it if what stands before both is equal; only the others are compared.
    """
    n = len(t)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    went_on = np.zeros(n, bool)
    went_on[1:] = (before[1:] > 0) & (t[np.maximum(before[1:], 1) - 1] == t[:-1])
    padded = np.concatenate([t.astype(np.uint16), np.arange(1, 9, dtype=np.uint16)])  # ends at different places differ
    word = np.ndarray((len(padded) - 3,), "<u8", padded, strides=(2,))
    todo, out, done = np.flatnonzero(~went_on & (before >= 0)), np.zeros(n, np.int64), 0
    while len(todo):
        high, low = np.maximum(todo, before[todo]) + done, np.minimum(todo, before[todo]) + done
        differ = np.ones(len(todo), bool)
        inside = high + 4 <= n
        differ[inside] = word[high[inside]] != word[low[inside]]
        for i, a, b in ((todo[differ], high[differ], low[differ]),):
            same = np.ones(len(i), bool)
            for k in range(4):  # which of the four symbols is the first that differs
                same &= (a + k < n) & (padded[np.minimum(a + k, n)] == padded[b + k])
                out[i] += same
        todo, done = todo[~differ], done + 4
        out[todo] = done
    last = np.maximum.accumulate(np.where(went_on, 0, np.arange(n)))
    return before, out[last] - (np.arange(n) - last)


def repeated_starts(text: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """For segments laid end to end, a flag for each start of a string of ``width`` bytes: does it start elsewhere too?"""
    off = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    t = np.zeros(int((sizes + 1).sum()), np.uint16)
    t[np.arange(len(text)) + np.repeat(np.arange(len(sizes)), sizes)] = text.astype(np.uint16) + 1
    counts = np.maximum(sizes - width + 1, 0)
    at = np.repeat(off, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    before, common = permuted_prefixes(t, suffix_array(t))
    # no string of a segment reaches its end, so a common prefix that long lies within both segments
    hit = common >= width
    hit[before[hit & (before >= 0)]] = True
    return hit[at]


# --- segments ---


def segments(data: np.ndarray, ends: np.ndarray, width: int, batch: int = 1 << 19):
    """First and last start, key and content hash of each segment, of all rows."""
    found, i, n = [], 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + batch, "right")) - 1)
        if ends[j] - ends[i] >= width:
            found.append([x if k > 1 else x + ends[i] for k, x in enumerate(_segments(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], width))])
        i = j
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segments(data: np.ndarray, off: np.ndarray, width: int):
    grams = width - GRAM + 1
    half = grams // 2
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    g = word[: len(word) - 8] * C._M1 + (word[8:] ^ (word[8:] >> np.uint64(29))) * C._M2
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xFF51AFD7ED558CCD)
    mask = np.uint64((1 << 32) - 1)  # of one width for all, so that equal strings choose alike
    low = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while 2 * size <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < grams:
        low = np.minimum(low[: len(low) - (grams - size)], low[grams - size :])
    _, rest = C.left(off)
    start = np.flatnonzero(rest[: len(low)] >= width)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    anchor = (low[start] & mask).astype(np.int64)
    far = anchor - start >= half
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1]) | (start[1:] != start[:-1] + 1))
    at = np.flatnonzero(new)
    first, last = start[at], start[np.append(at[1:], len(start)) - 1]
    anchor, far = anchor[at], far[at]
    p = C.prefix_hash(data)
    _, inv = C.powers(len(data) + 1)
    hashed = lambda a, b: C.mix((p[b] - p[a]) * inv[a])
    # strings that begin half or more before the anchor share what is from there to the gram's end; the others what follows it
    key = hashed(np.where(far, anchor - half, anchor), np.where(far, anchor + GRAM, anchor + width - half + 1)) + far.astype(np.uint64)
    content = C.mix(hashed(first, last + width) + (anchor - first).astype(np.uint64) * C._M1)
    return first, last, C.mix(key), content


SENT = "chunk int, bucket int, keys binary, more binary, twice binary"


def _count(most: int):
    """Bits for each segment a chunk has: it occurs again as a whole; it has to go to its shard; its key is a hot one."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("keys").to_pylist()
        n = np.array([len(x) // 8 for x in parts])
        keys, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("keys", "more"))
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for x, c in zip(table.column("twice").to_pylist(), n, strict=True)]).astype(bool)
        owner = np.repeat(table.column("chunk").to_numpy(), n)
        order = np.lexsort((owner, more, keys))
        k, m = keys[order], more[order]
        same_key = np.append(False, k[1:] == k[:-1])
        new = ~(same_key & np.append(False, m[1:] == m[:-1]))
        hit = again[order]
        hit |= ~new
        hit[:-1] |= ~new[1:]
        group = np.cumsum(~same_key) - 1
        contents = np.bincount(group, weights=new)[group]
        whole, ship, hot = (np.empty(len(keys), bool) for _ in range(3))
        whole[order], ship[order], hot[order] = hit, new & (contents > 1) & (contents <= most), contents > most
        cut = np.cumsum(n)[:-1]
        pack = lambda x: pa.array([np.packbits(y).tobytes() for y in np.split(x, cut)], pa.binary())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "whole": pack(whole), "ship": pack(ship), "hot": pack(hot)})

    return run


def _bits(reply: pa.Table, col: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    return C.replied(reply.select(["bucket", col]).rename_columns(["bucket", "bits"]), keys, buckets)


def _settle(width: int):
    """Bits for what chunks sent: segments of a shard, or single strings of hot keys."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("hot")[0].as_py():
            done = C._count(table.select(["chunk", "bucket", "a", "b", "twice"]).rename_columns(["chunk", "bucket", "keys", "more", "twice"]))
            return done.append_column("hot", table.column("hot"))
        sizes = [np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("a").to_pylist()]
        text = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8)
        hit = repeated_starts(text, np.concatenate(sizes), width)
        cut = np.cumsum([int((s - width + 1).sum()) for s in sizes])[:-1]
        bits = pa.array([np.packbits(x).tobytes() for x in np.split(hit, cut)], pa.binary())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": bits, "hot": table.column("hot")})

    return run


def suffix_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", with_text: bool = False, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; if asked for, ``kept_text`` and ``text``; and ``keep``.

    A byte goes if a string of ``width`` bytes (``GRAM`` + 8 at least) that covers it starts anywhere
    else too.  ``kept_text`` is what is left, U+FFFD where a character was cut.  ``hot`` bounds the segments
    of a key in a shard, and changes no result.
    """
    total = C.text_bytes(docs)
    n, buckets = C.sizes(total, 0.4)
    shards = max(min(n, 12), total // SHARD_BYTES + 1)
    chunked = C.chunked(docs.withColumnsRenamed({id_col: "doc_id"}), n, keep=keep)
    types = dict(docs.dtypes)

    def known(data: np.ndarray, ends: np.ndarray):
        first, last, key, content = segments(data, ends, width)
        keys, more, twice, place = C.distinct(key, content)
        return first, last, keys, more, twice, place

    def send(table: pa.Table) -> pa.Table:
        _, _, keys, more, twice, _ = known(*C.buffers(table))
        return C.census_rows(table.column("chunk")[0].as_py(), keys, more, twice, buckets)

    def chosen(first, last, place, ship):
        """Of the distinct segments to ship, in their order, first start and size of one copy."""
        one = np.full(len(ship), -1)
        one[place[::-1]] = np.arange(len(place))[::-1]
        one = one[ship]
        return first[one], last[one] - first[one] + width

    def strings(data, first, last, chosen):
        """Of the segments of hot keys: the starts of all strings, and their distinct hashes."""
        count = (last - first + 1)[chosen]
        at = np.repeat(first[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if not len(at):
            return (at, *C.distinct(np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
        _, inv = C.powers(len(data) + 1)
        a, b = (C.mix((p[at + width] - p[at]) * inv[at]) for p in (C.prefix_hash(data), C.prefix_hash(data ^ np.uint8(0xA5))))
        return (at, *C.distinct(a, (b >> np.uint64(32)).astype(np.uint32)))

    def ship_rows(table: pa.Table, reply: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            data, ends = C.buffers(table)
            first, last, keys, _, _, place = known(data, ends)
            ship = _bits(reply, "ship", keys, buckets)
            _, uniq, more, twice, _ = strings(data, first, last, _bits(reply, "hot", keys, buckets)[place])
            chunk = table.column("chunk")[0].as_py()
            for r in C.census_rows(chunk, uniq, more, twice, buckets).to_pylist():
                rows.append((chunk, r["bucket"], True, r["keys"], r["more"], r["twice"]))
            start, size = chosen(first, last, place, ship)
            found, cut = C.spread(keys[ship], shards)
            for b, i, j in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                text = b"".join([data[s : s + k].tobytes() for s, k in zip(start[i:j].tolist(), size[i:j].tolist(), strict=True)])
                rows.append((chunk, b, False, size[i:j].astype(np.int32).tobytes(), text, None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("chunk", "bucket", "hot", "a", "b", "twice"), cols, types, strict=True)})

    def end(table: pa.Table, replies: pa.Table) -> pa.Table:
        data, ends = C.buffers(table)
        first, last, keys, _, _, place = known(data, ends)
        phase = replies.column("phase").to_numpy()
        one, two, three = (replies.filter(pa.array(phase == i)) for i in (1, 2, 3))
        whole, ship = _bits(one, "whole", keys, buckets), _bits(one, "ship", keys, buckets)
        flag = np.zeros(len(data) + 1, np.int32)
        full = whole[place]
        np.add.at(flag, first[full], 1)
        np.add.at(flag, last[full] + 1, -1)
        flag = np.cumsum(flag[:-1]) > 0
        start, size = chosen(first, last, place, ship)
        found, cut = C.spread(keys[ship], shards)
        for b, bits in zip(np.searchsorted(found, two.column("bucket").to_numpy()).tolist(), two.column("bits").to_pylist(), strict=True):
            s, k = start[cut[b] : cut[b + 1]], size[cut[b] : cut[b + 1]] - width + 1
            at = np.repeat(s, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            flag[at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)]] = True
        at, uniq, _, _, where = strings(data, first, last, _bits(one, "hot", keys, buckets)[place])
        flag[at[C.replied(three.select(["bucket", "bits"]), uniq, buckets)[where]]] = True
        gone = C.covered(flag, width)
        edge = np.append(False, gone[:-1])
        edge[ends[:-1][ends[:-1] < len(data)]] = False
        spans, total_gone = np.concatenate([[0], np.cumsum(gone & ~edge)]), np.concatenate([[0], np.cumsum(gone)])
        kept = [data[i:j][~gone[i:j]].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        cols = {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(np.diff(ends), pa.int64()),
            "n_removed": pa.array(total_gone[ends[1:]] - total_gone[ends[:-1]], pa.int64()),
            "n_spans": pa.array(spans[ends[1:]] - spans[ends[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if with_text:
            cols["kept_text"] = pa.array([x.decode(errors="replace") for x in kept], pa.string())
            cols["text"] = table.column("text")
        return pa.table(cols | {k: table.column(k) for k in keep})

    census = chunked.groupBy("chunk").applyInArrow(send, SENT).groupBy("bucket").applyInArrow(_count(hot), "chunk int, bucket int, whole binary, ship binary, hot binary")
    sent = chunked.groupBy("chunk").cogroup(census.groupBy("chunk")).applyInArrow(ship_rows, "chunk int, bucket int, hot boolean, a binary, b binary, twice binary")
    settled = sent.groupBy("hot", "bucket").applyInArrow(_settle(width), C.REPLY + ", hot boolean")
    none = [f"CAST(null AS binary) AS {c}" for c in ("whole", "ship", "hot")]
    replies = census.selectExpr("*", "CAST(null AS binary) AS bits", "1 AS phase").unionByName(settled.selectExpr("chunk", "bucket", "bits", "IF(hot, 3, 2) AS phase", *none))
    schema = RESULT + (", kept_text string, text string" if with_text else "") + "".join(f", `{k}` {types[k]}" for k in keep)
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(end, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
