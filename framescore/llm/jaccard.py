"""N-gram Jaccard join by parity sketches.

A document's word shingles are a set of 64-bit hashes.  Its sketch has, for a size band, B
blocks of bits: a shingle's high bits choose the block, its low bits the bit, which it flips.  The
Hamming distance of two sketches is at most the symmetric difference of the sets, and so is
the number of blocks that differ.  Sets with a Jaccard similarity of p/q differ in at most
(q - p) / (q + p) of their summed sizes, t within a band; of B = t + 1 + z blocks at least z + 1
are equal, and since a document leaves out its lightest blocks, z at most and by weight, one
of those is a key that both send out (a block's key is the XOR of its flipped bits' hashes).

Keys that occur once are dropped by the chunks' census.  Equal sets become one class.  Each key
compares its classes with the most central one, first by sketches, then by the sets, whose texts are fetched for
such pairs only.  Then, in keys whose classes are still in different components, the pairs across
them are compared by sketches, without those that the metric rules out, and the rest by sets.  So no link is
lost and no group of near copies is expanded into all its pairs.  Large keys are dealt out in blocks, and
all joins on keys, hubs, components or copies go by ``heavy_join`` or salted groups.

A document with fewer words than a shingle has its whole sequence as its only one; null and
empty texts have none and link with nothing, nor do rows without an id.  Rows that repeat an
id each give a row, with one component.
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
from .components import components

#: Sizes of a band reach from its upper end down to this share of it.
BAND = 0.6
#: Pairs, of 24 bytes each, that are broadcast at most.
FEW = 200_000
_ROW = "doc_id long, n long, sig_a long, sig_b long, head boolean"


@functools.lru_cache(4096)
def band_plan(band: int, p: int, q: int) -> tuple[int, int]:
    """Blocks of a band and how many of the lightest a document may leave out."""
    most = math.floor(BAND ** -(band + 1)) + 1
    t = (q - p) * 2 * most // (q + p)
    z = 0 if t < 4 else math.ceil(0.15 * (t + 1))
    return t + 1 + z, z


def bands(n: int, p: int, q: int) -> list[int]:
    """The band of a size, and the next one if a partner can be there."""
    band = int(math.log(n) / -math.log(BAND) + 1e-9)
    return [band, band + 1] if n * q >= p * math.floor(BAND ** -(band + 1)) else [band]


def keys_of(shingles: np.ndarray, p: int, q: int) -> np.ndarray:
    """Block keys that a sorted set of shingle hashes sends out."""
    out, bits, high = [], C.mix(shingles & np.uint64(0xFFFFFFFF)), shingles >> np.uint64(32)
    for band in bands(len(shingles), p, q):
        blocks, spare = band_plan(band, p, q)
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        weight = np.diff(np.append(at, len(block)))
        number = block[at]
        parity = np.bitwise_xor.reduceat(bits, at)
        empty = blocks - len(at)
        if empty > spare:  # all blocks, the empty ones too
            full, every = np.zeros(blocks, np.uint64), np.arange(blocks, dtype=np.uint64)
            full[number.astype(np.int64)] = parity
            number, parity = every, full
        elif empty + int((weight < 2).sum()) <= spare:
            number, parity = number[weight > 1], parity[weight > 1]
        out.append(C.mix(parity + number * C._M1 + np.uint64((band + 1) * int(C._M2) % (1 << 64))))
    return np.concatenate(out)


def sets_of(table: pa.Table, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, ends = C.buffers(table)
    h, off = C.word_hashes(C.fold_ascii(data), ends)
    rolled = C.rolled(h, words)
    out = []
    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        out.append(np.unique(rolled[i : j - words + 1] if j - i >= words else C.rolled(h[i:j], j - i) if j > i else rolled[:0]))
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(C.mix(s)).view(np.int64)) if len(s) else 0, int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def candidates(docs: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """A row for each document.  One of those with equal sets is the head, and heads with a key that
    another head has too hold such keys and the set's sketch."""
    n, buckets = C.sizes(C.text_bytes(docs), 0.45)
    chunked = C.chunked(docs, n)

    def local(table: pa.Table):
        """Sets, signatures, and by signature the place of its first row with an id."""
        sets = sets_of(table, words)
        sigs = [_signature(s) for s in sets]
        first: dict[tuple[int, int], int] = {}
        for i, (doc, s) in enumerate(zip(table.column("doc_id").to_pylist(), sets, strict=True)):
            if doc is not None and len(s):
                first.setdefault(sigs[i], i)
        order = sorted(first, key=lambda s: (s[0] % (1 << 64), s[1] % (1 << 64)))
        return sets, sigs, [first[s] for s in order], *(np.array([s[i] for s in order], np.int64).view(np.uint64) for i in (0, 1))

    def sign(table: pa.Table) -> pa.Table:
        _, _, _, a, b = local(table)
        return C.census_rows(table.column("chunk")[0].as_py(), a, b, np.zeros(len(a), bool), buckets)

    def heads_of(table: pa.Table, reply: pa.Table):
        sets, sigs, first, a, _ = local(table)
        heads = [i for i, x in zip(first, C.replied(reply, a, buckets), strict=True) if x]
        return sets, sigs, heads, [keys_of(sets[i], p, q) for i in heads]

    def send(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.census_rows(0, np.zeros(0, np.uint64), None, np.zeros(0, bool), buckets)
        uniq, _, twice, _ = C.distinct(np.concatenate([np.zeros(0, np.uint64), *heads_of(table, reply)[3]]))
        return C.census_rows(table.column("chunk")[0].as_py(), uniq, None, twice, buckets)

    def back(table: pa.Table, replies: pa.Table) -> pa.Table:
        phase = replies.column("phase").to_numpy()
        sets, sigs, heads, keys = heads_of(table, replies.filter(pa.array(phase == 1)))
        uniq, _, _, place = C.distinct(np.concatenate([np.zeros(0, np.uint64), *keys]))
        hit = C.replied(replies.filter(pa.array(phase == 2)), uniq, buckets)[place]
        found: list = [None] * len(sets)
        bits: list = [None] * len(sets)
        at = 0
        for i, k in zip(heads, keys, strict=True):
            mine = k[hit[at : at + len(k)]]
            at += len(k)
            if len(mine):
                found[i], bits[i] = mine.view(np.int64), sketch(sets[i])
        head = np.zeros(len(sets), bool)
        head[heads] = True
        a, b = zip(*sigs, strict=True) if sigs else ((), ())
        cols = [table.column("doc_id").cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(head), pa.array(found, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
        return pa.table(dict(zip(["doc_id", "n", "sig_a", "sig_b", "head", "keys", "sketch"], cols, strict=True)))

    one = C.first_census(chunked.groupBy("chunk").applyInArrow(sign, C.CENSUS))
    two = C.census(chunked.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(send, C.CENSUS))
    replies = one.selectExpr("*", "1 AS phase").unionByName(two.selectExpr("*", "2 AS phase"))
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(back, _ROW + ", keys array<long>, sketch binary")


def sketch(s: np.ndarray) -> bytes:
    """Parity of the set's hashes in each of twice as many bits or more, a power of two."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger folded to the size of the smaller: never more than the sets' symmetric difference."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


#: What is known of a pair: farther apart than any two that link to a common third; not linked; maybe linked.
FAR, NOT, MAYBE = 0, 1, 2


def state(n: int, m: int, a: bytes, b: bytes, p: int, q: int) -> int:
    """What sizes and sketches of two sets tell of them.

    Jaccard distance is a metric, so sets whose distance is above 2 (q - p) / q have no set that links to both.
    """
    differ = max(apart(a, b), abs(n - m))
    if differ * p > (q - p) * (n + m):
        return FAR
    return MAYBE if differ * (q + p) <= (q - p) * (n + m) else NOT


def near_pairs(ids, comp, n, known, side, sketches: list[bytes], p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components, one of each side if both are there, whose sizes and sketches don't rule out a link.

    ``known``: of each, what is known of it and the key's hub; those linked to the hub can't link to those far from it.
    """
    order = np.argsort(n, kind="stable")
    ids, comp, n, known, side = (x[order] for x in (ids, comp, n, known, side))
    cross = bool(side.any() and not side.all())
    size = np.array([len(sketches[i]) for i in order])
    own = {w: np.flatnonzero(size == w) for w in np.unique(size).tolist()}
    whole = {w: np.frombuffer(b"".join([sketches[order[i]] for i in at]), np.uint64).reshape(len(at), w // 8) for w, at in own.items()}
    halves = {w // 2: m[:, : w // 16] ^ m[:, w // 16 :] for w, m in whole.items() if w > 8}  # a sketch of half the bits
    for w, at in own.items():
        for k, i in enumerate(at):
            for j, rows in ((at[k + 1 :], whole[w][k + 1 :]), (own.get(2 * w, at[:0]), halves.get(w))):
                end = int(np.searchsorted(n[j], n[i] * q // p, "right")) if len(j) else 0
                if not end:
                    continue
                j = j[:end]
                ok = (comp[j] != comp[i]) & ((known[j] == NOT) | (known[i] == NOT) | (known[j] == known[i]))
                if cross:
                    ok &= side[j] != side[i]
                if not ok.any():
                    continue
                j = j[ok]
                far = np.bitwise_count(rows[:end][ok] ^ whole[w][k]).sum(1, dtype=np.int64)
                ok = far * (q + p) <= (q - p) * (n[j] + n[i])
                if ok.any():
                    yield np.full(int(ok.sum()), ids[i]), ids[j[ok]]


#: Rows of a key that are compared in one group, at most (of two blocks, twice as many).
BLOCK = 512


def across(rows: DataFrame, shape: DataFrame, p: int, q: int, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """Pairs (u, v) of rows (key, v, c, known) that share a key, are in different components and, by their ``shape`` (doc_id, n, sketch), may be linked.

    A key with more than ``block`` rows is dealt out by size, one factor q / p to a class, and blocks of a
    class meet each other and those of the next class only: sets further apart in size don't link.
    ``most``: the rows of one key at most, where that is known.
    """
    step = math.log(q / p) if q > p else 1.0
    # sizes whose ratio is q / p at most are in one class or in neighbouring ones, the rounding of logarithms included
    shape = shape.withColumnRenamed("doc_id", "v")
    rows = rows.join(shape.select("v", "n").distinct(), "v")
    rows = rows.withColumn("s", F.floor(F.log("n") / F.lit(step * (1 + 1e-9))).cast("int"))
    per = rows.groupBy("key", "s").agg(F.count("*").alias("cnt"))
    by_key = Window.partitionBy("key")
    per = per.withColumn("all", F.sum("cnt").over(by_key)).withColumn("blocks", F.ceil(F.col("cnt") / block).cast("int"))
    beside = lambda f: F.when(f("s").over(by_key.orderBy("s")) == F.col("s") + (1 if f is F.lead else -1), f("blocks").over(by_key.orderBy("s"))).otherwise(0)
    per = per.withColumn("up", beside(F.lead)).withColumn("down", beside(F.lag))
    one = F.array(F.struct(*(F.lit(x).alias(k) for k, x in (("s1", 0), ("i", 0), ("s2", 0), ("j", 0), ("side", False)))))
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    at = lambda s1, i, s2, j, side: F.struct(s1.alias("s1"), i.alias("i"), s2.alias("s2"), j.alias("j"), side.alias("side"))
    every = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array().cast("array<struct<s1:int,i:int,s2:int,j:int,side:boolean>>"))
    s = F.col("s")
    dealt = F.concat(
        every("blocks", lambda o: at(s, F.least(own, o), s, F.greatest(own, o), own > o)),
        every("up", lambda o: at(s, own, s + 1, o, F.lit(False))),
        every("down", lambda o: at(s - 1, o, s, own, F.lit(True))),
    )
    sent = C.heavy_join(rows, per, ["key", "s"], "cnt", most=most).withColumn("g", F.explode(F.when(F.col("all") <= block, one).otherwise(dealt)))
    group = ["key", "s1", "i", "s2", "j"]
    sent = sent.select("key", "g.s1", "g.i", "g.s2", "g.j", "g.side", "v", "c", "n", "known").join(shape, ["v", "n"])  # sketches come last, so that they are moved once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def starts(table: pa.Table) -> np.ndarray:
            k = [table.column(x).to_numpy() for x in group]
            return np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in k], axis=0))) if len(k[0]) else np.zeros(0, int)

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            s1, i, s2, j, v, c, n, known, side = (table.column(x).to_numpy() for x in ("s1", "i", "s2", "j", "v", "c", "n", "known", "side"))
            s, cut, found = table.column("sketch").to_pylist(), starts(table).tolist(), []
            for a, b in zip(cut, [*cut[1:], len(v)], strict=True):
                two = s1[a] != s2[a] or i[a] != j[a]
                if b - a > 1 and (not two or side[a:b].any() and not side[a:b].all()):
                    found += near_pairs(v[a:b], c[a:b], n[a:b], known[a:b], side[a:b], s[a:b], p, q)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            cut = starts(held[-1])
            # the first group of a batch may have begun before it, the last one may go on
            first = held[-1].slice(0, 1).select(group)
            if len(held) > 1 and not held[-2].slice(held[-2].num_rows - 1).select(group).equals(first):
                yield from pairs(pa.concat_tables(held[:-1]))
                held[:] = held[-1:]
            if len(cut) > 1:
                yield from pairs(pa.concat_tables([*held[:-1], held[-1].slice(0, cut[-1])]))
                held[:] = [held[-1].slice(cut[-1])]
        if held:
            yield from pairs(pa.concat_tables(held))

    return sent.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long")


#: Words of the texts that one group compares with one other, on average at most.
GROUP_WORDS = 200_000


def compared(pairs: DataFrame, sizes: DataFrame, held: DataFrame, check, few: int = FEW) -> DataFrame:
    """``u``, ``v`` and ``state``, the largest that ``check`` gives for rows of ``held`` (doc_id, ...) with these ids.

    ``held`` rows with the id v go to the groups of u, which has one for each ``GROUP_WORDS`` words, by ``sizes`` (doc_id, n),
    of all its v.  Up to ``few`` pairs are broadcast, so of ``held`` only rows in pairs are moved; more are joined.
    """
    pairs = C.checkpoint(pairs, count=F.count("*"))
    count = pairs.measured["count"]
    # many partners of one u: dealt out in groups
    load = pairs.join(sizes.groupBy("doc_id").agg(F.max("n").alias("n")).withColumnRenamed("doc_id", "v"), "v").groupBy("u").agg(F.count("*").alias("pairs_of"), F.sum("n").alias("words"))
    load = C.checkpoint(load.select("u", "pairs_of", F.greatest(F.lit(1), F.ceil(F.col("words") / GROUP_WORDS)).cast("int").alias("groups")), most=F.max("pairs_of"))
    salted = C.heavy_join(pairs, load, ["u"], "pairs_of", count, load.measured["most"] or 0).select("u", "v", F.pmod(F.xxhash64("v"), F.col("groups")).cast("int").alias("salt"))
    to_u = load.select("u", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    put = F.broadcast if count <= few else lambda x: x
    theirs = held.join(put(salted.withColumnRenamed("v", "doc_id")), "doc_id").withColumnRenamed("doc_id", "v")
    ones = held.select(*(F.col(c).alias(c) for c in held.columns)).join(put(to_u.withColumnRenamed("u", "doc_id")), "doc_id").withColumnRenamed("doc_id", "u")
    found = ones.groupBy("u", "salt").cogroup(theirs.groupBy("u", "salt")).applyInArrow(lambda a, b: _each(a, b, check), "u long, v long, state int")
    return found.groupBy("u", "v").agg(F.max("state").alias("state"))


def _each(ones: pa.Table, theirs: pa.Table, check) -> pa.Table:
    u = ones.column("u").to_pylist()[:1] or theirs.column("u").to_pylist()[:1]
    got = check(ones, theirs) if ones.num_rows else np.zeros(0, np.int32)
    v = theirs.column("v") if ones.num_rows else theirs.column("v").slice(0, 0)
    return pa.table({"u": pa.array(np.repeat(np.array(u, np.int64), len(v))), "v": v, "state": pa.array(got, pa.int32())})


def _by_sketch(p: int, q: int):
    def check(ones: pa.Table, theirs: pa.Table) -> list[int]:
        mine = list(zip(ones.column("n").to_pylist(), ones.column("sketch").to_pylist(), strict=True))
        return [max(state(n, m, a, b, p, q) for n, a in mine) for m, b in zip(theirs.column("n").to_pylist(), theirs.column("sketch").to_pylist(), strict=True)]

    return check


def _by_set(words: int, p: int, q: int):
    """1 where the shingles' 64-bit hashes have so large an intersection, else 0."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return len(x) > 0 < len(y) and q * common >= p * (len(x) + len(y) - common)

    def check(ones: pa.Table, theirs: pa.Table) -> list[int]:
        mine = sets_of(ones, words)
        return [int(any(linked(x, y) for x in mine)) for i in range(theirs.num_rows) for y in sets_of(theirs.slice(i, 1), words)]

    return check


def jaccard_components(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``: links at an intersection of p/q of the union or more.

    ``few`` and ``block`` choose how rows are moved, never which are compared.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = C.checkpoint(candidates(docs, words, p, q))
    usable = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = usable.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("low"), F.max(F.when(F.col("head"), F.col("doc_id"))).alias("node"), F.count("*").alias("copies"))
    sets = rows.where("keys IS NOT NULL").select("doc_id", "n", "keys", "sketch")
    texts = docs.where("doc_id IS NOT NULL")
    spread = sets.select(F.col("doc_id").alias("v"), F.explode("keys").alias("key"))
    # a key's hub is the one that others share most keys with: of copies of one text, that text
    common = C.checkpoint(spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), most=F.max("c"), total=F.sum("c"))
    most, total = (common.measured[k] or 0 for k in ("most", "total"))  # of one key, which below has no more rows than here
    spread = C.checkpoint(C.heavy_join(spread, common, ["key"], "c", total, most))
    central = spread.groupBy("v").agg(F.sum("c").alias("s"))
    hubs = spread.join(central, "v").groupBy("key").agg(F.max(F.struct("s", -F.col("v"))).alias("h"), F.count("*").alias("c")).select("key", (-F.col("h.col2")).alias("h"), "c")
    spread = C.checkpoint(C.heavy_join(spread.drop("c"), hubs, ["key"], "c", total, most).withColumns({"lo": F.least("h", "v"), "hi": F.greatest("h", "v")}))
    shape = sets.select("doc_id", "n", "sketch")
    star = spread.where("lo < hi").select(F.col("lo").alias("u"), F.col("hi").alias("v")).distinct()
    seen = C.checkpoint(compared(star, shape, shape, _by_sketch(p, q), few))
    links = C.checkpoint(compared(seen.where(f"state = {MAYBE}").select("u", "v"), shape, texts, _by_set(words, p, q), few).where("state = 1").select("u", "v"))
    # what is still apart in a key
    label = components(links)
    known = seen.join(links.withColumn("linked", F.lit(True)), ["u", "v"], "left").select(F.col("u").alias("lo"), F.col("v").alias("hi"), F.when(F.col("linked"), MAYBE).when(F.col("state") == FAR, FAR).otherwise(NOT).alias("known"))
    labelled = spread.join(label.withColumnRenamed("node", "v"), "v", "left").join(known, ["lo", "hi"], "left")
    # of an id with several texts one may link to the hub and another to what is far from it
    several = sets.groupBy(F.col("doc_id").alias("v")).agg(F.count("*").alias("texts")).where("texts > 1")
    what = F.when(F.col("texts").isNotNull(), NOT).otherwise(F.coalesce("known", F.lit(MAYBE)))
    # the hub itself has met all others
    labelled = C.checkpoint(labelled.where("lo < hi").join(several, "v", "left").select("key", "v", F.coalesce("component", "v").alias("c"), what.alias("known"), "texts"), total=F.count("*"), several=F.count("texts"))
    # those linked to the hub have only those to meet that are neither linked to it nor far from it
    rest = F.when(F.col("known") != MAYBE, F.col("c"))
    per_key = labelled.groupBy("key").agg(F.count("*").alias("rows_of"), F.count(F.when(F.col("known") == NOT, 1)).alias("open"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(rest).alias("rest_lo"), F.max(rest).alias("rest_hi"))
    todo = C.heavy_join(labelled, per_key, ["key"], "rows_of", labelled.measured["total"], most).where(f"lo < hi AND (open > 0 OR known != {MAYBE} AND rest_lo < rest_hi)")
    todo = C.checkpoint(todo.select("key", "v", "c", "known"))  # read twice; a smaller plan, too
    pairs = across(todo, shape, p, q, block, None if labelled.measured["several"] else most).distinct()
    pairs = pairs.join(seen.select("u", "v"), ["u", "v"], "left_anti")
    links = links.unionByName(compared(pairs, shape, texts, _by_set(words, p, q), few).where("state = 1").select("u", "v"))
    label = components(links)
    placed = C.checkpoint(classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), n=F.count("*"), most=F.max("copies"), total=F.sum("copies"))
    rows_of = placed.measured
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("classes"))
    found = C.heavy_join(placed, lowest, ["component"], "classes", rows_of["n"], rows_of["n"] if rows_of["n"] <= C.LIGHT else None).select("sig_a", "sig_b", "component_id", "copies")
    named = C.heavy_join(usable.select("doc_id", "n", "sig_a", "sig_b"), found, ["sig_a", "sig_b"], "copies", rows_of["total"] or 0, rows_of["most"] or 0)
    alone = rows.where("doc_id IS NULL OR n = 0").withColumn("component_id", F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)
