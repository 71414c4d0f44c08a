"""Embedding near-duplicates by collision-counting projections.

Vectors are put on the unit sphere and projected on many lines.  A line is the sum of one line of each
of ``FAMILIES`` families of ``m`` random ones, so ``(2 m) ** FAMILIES`` ends of lines cost ``FAMILIES * m``
products a vector.  Every line is sorted; near its middle a window holds a third of all vectors, near
its ends few.  So each vector is a query on the ``k`` lines only on which it stands furthest out: a pair collides
on a line if both are there and one lies in the window centred on the other.  Collisions are counted a pair,
and pairs with ``least`` of them are verified by their cosine in double precision.  ``k`` and ``least`` are
calibrated on made-up pairs just at the threshold; ``m`` grows with the root of the number of vectors,
which holds the collisions of unlike vectors at about as many a vector.

A line end on which more than ``LIGHT`` vectors stand is *crowded*, by a group of near copies.  Its pairs
aren't made.  Each vector there belongs to its most crowded line end, its *home*; homes that share a
line end are compared as a whole, block by block, and only the links of each vector are counted.

Equal vectors, by 128 bits of hashes, become one class first, of which one is compared.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths don't link; a null id gives a null component
and takes no part.  Rows that repeat an id have one component, and links of their own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .components import components

#: Summands of a line, lines of a family for each root of the number of vectors, and at least.
FAMILIES, GROWTH, LEAST_LINES = 3, 0.57, 16
#: Lines of a vector that are tried in turn, and the recall wanted for a pair just at the threshold.
LINES, RECALL = (8, 16, 24, 32, 48, 64, 96, 128, 192, 256), 0.94
#: Vectors at a line end whose pairs are made one by one, at most; bytes of vectors in one block.
LIGHT, BLOCK_BYTES = 64, 2 << 20


def _best(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k largest of each row, from the largest."""
    at = np.argpartition(-values, k - 1, axis=1)[:, :k] if values.shape[1] > k else np.tile(np.arange(values.shape[1]), (len(values), 1))
    found = np.take_along_axis(values, at, 1)
    order = np.argsort(-found, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(found, order, 1)


@functools.lru_cache(256)
def _sums(a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two sorted lists, the places whose sums can be among the k largest."""
    return tuple(map(np.array, zip(*[(i, j) for i in range(a) for j in range(min(b, k // (i + 1)))], strict=True)))


class Plan:
    """Lines for so many vectors and a threshold; ``of`` has what follows for one length of vectors."""

    def __init__(self, n: int, threshold: float, seed: int = 17):
        self.threshold, self.seed = threshold, seed
        self.m = max(LEAST_LINES, math.ceil(GROWTH * math.sqrt(n)))
        # nearly all pairs at the threshold lie so close on a line
        self.window = 2.6 * math.sqrt(FAMILIES * (2 - 2 * threshold))
        self.known: dict[int, tuple[list[np.ndarray], int, int]] = {}

    def ends(self, unit: np.ndarray, families: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k ends of lines where each vector stands furthest out, and how far."""
        end, out = None, None
        for f in families:
            p = unit @ f
            at, far = _best(np.abs(p), min(k, self.m))
            mine = 2 * at.astype(np.int64) + (np.take_along_axis(p, at, 1) > 0)
            if end is None:
                end, out = mine, far
                continue
            i, j = _sums(end.shape[1], mine.shape[1], k)
            at, out = _best(out[:, i] + far[:, j], k)
            end = np.take_along_axis(end[:, i] * (2 * self.m) + mine[:, j], at, 1)
        return end, out

    def of(self, size: int) -> tuple[list[np.ndarray], int, int]:
        """Families, ``k`` and ``least`` for vectors of a length, calibrated on pairs just at the threshold."""
        if size not in self.known:
            r = np.random.default_rng([self.seed, size])
            families = [r.standard_normal((size, self.m)) for _ in range(FAMILIES)]
            x, y = (r.standard_normal((1000, size)) for _ in range(2))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y -= (x * y).sum(1, keepdims=True) * x
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            y = self.threshold * x + math.sqrt(1 - self.threshold**2) * y if size > 1 else x
            for k in LINES:
                (a, va), (b, vb) = self.ends(x, families, k), self.ends(y, families, k)
                count = np.array([((p[:, None] == q) & (np.abs(v[:, None] - w) <= self.window)).sum() for p, v, q, w in zip(a, va, b, vb, strict=True)])
                least = max(1, int(np.quantile(count, 1 - RECALL, method="lower")))
                if least > 1:
                    break
            self.known[size] = families, k, least
        return self.known[size]


def _units(col: pa.Array, size: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each length."""
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        yield at, _units(lists.take(pa.array(at)), int(size))


def _one(col) -> pa.Array:
    col = col.combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col


def _links(table: pa.Table, threshold: float) -> pa.Table:
    """Of the vectors of one block, or of two (``side``): links of each, and the smallest id each reaches here."""
    head, many, node, side = (table.column(c).to_numpy() for c in ("head", "many", "node", "side"))
    total, label = np.zeros(len(head), np.int64), np.arange(len(head))
    cross = bool(side.any() and not side.all())
    pair = table.column("a")[0].as_py() != table.column("b")[0].as_py() or table.column("i")[0].as_py() != table.column("j")[0].as_py()
    if pair and not cross:
        return table.select(["node"]).slice(0, 0).append_column("n", pa.array([], pa.int64())).append_column("head", pa.array([], pa.int64())).append_column("to", pa.array([], pa.int64()))
    for at, unit in _by_size(_one(table.column("embedding"))):
        rows, cols = (at[side[at]], at[~side[at]]) if cross else (at, at)
        u, v = (unit[side[at]], unit[~side[at]]) if cross else (unit, unit)
        for i in range(0, len(rows), 512):
            close = u[i : i + 512] @ v.T >= threshold
            if not cross:
                close[np.arange(len(close)), np.arange(i, i + len(close))] = False
            total[rows[i : i + 512]] += close @ many[cols]
            if cross:
                total[cols] += many[rows[i : i + 512]] @ close
            p, q = np.nonzero(close)
            p, q = rows[i : i + 512][p], cols[q]
            while len(p):  # contract what this slice links
                low = label.copy()
                np.minimum.at(low, label[p], label[q])
                np.minimum.at(low, label[q], low[label[p]])
                while (low[low] != low).any():
                    low = low[low]
                label = low[label]
                apart = label[p] != label[q]
                p, q = p[apart], q[apart]
    some = np.flatnonzero(total)
    return pa.table({"node": node[some], "n": total[some], "head": head[some], "to": head[label[some]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per row ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding", F.lit(11))})
    classes = rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("head"), F.count("*").alias("many"), F.first("embedding").alias("embedding"))
    classes = C.checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    n, total, width = classes.agg(F.count("*"), F.sum("many"), F.max(F.size("embedding"))).first()
    plan = Plan(n, threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector and line end of its own.  Those of an end that is crowded in one batch are dealt out over all
        tasks by ``salt``, and one row without a vector tells the end's own task."""
        for b in batches:
            node = b.column("node").to_numpy()
            for at, unit in _by_size(b.column("embedding")):
                families, k, _ = plan.of(unit.shape[1])
                end, far = plan.ends(unit, families, k)
                end = C.mix(end.astype(np.uint64).ravel() + np.full(1, unit.shape[1], np.uint64) * C._M1).view(np.int64)
                who, far = np.repeat(node[at], k), far.ravel().astype(np.float32)
                ends, place, count = np.unique(end, return_inverse=True, return_counts=True)
                crowded = count > LIGHT
                salt = np.where(crowded[place], 1 + who % 1024, 0).astype(np.int32)
                more = ends[crowded]
                cols = np.concatenate([end, more]), np.concatenate([salt, np.zeros(len(more), np.int32)]), np.concatenate([who, np.full(len(more), -1)]), np.concatenate([far, np.full(len(more), -1, np.float32)])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["line", "salt", "node", "far"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (u, v) that collide at a line end, and (line, vector) of crowded ends."""
        line, salt, crowded = None, 0, False
        held: list[tuple[int, float]] = []
        out: list[tuple[bool, int, int]] = []

        def pairs() -> None:
            for i, (u, x) in enumerate(held):
                for v, y in held[i + 1 :]:
                    if y - x > plan.window:
                        break
                    out.append((False, min(u, v), max(u, v)))

        def made() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else ([], [], [])
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["crowded", "u", "v"])
            out.clear()
            return batch

        for b in batches:
            # most ends have one vector only; those at the edges of a batch may go on
            key = b.column("line").to_numpy()
            again = np.append(False, key[1:] == key[:-1])
            again |= np.append(again[1:], True) | (b.column("salt").to_numpy() > 0)
            again[:1] = True
            b = b.filter(pa.array(again))
            for now, s, node, far in zip(*(b.column(c).to_pylist() for c in ("line", "salt", "node", "far")), strict=True):
                if now != line or s != salt:
                    pairs()
                    held.clear()
                    line, salt, crowded = now, s, s > 0
                if node < 0:
                    crowded = True
                elif crowded:
                    out.append((True, line, node))
                else:
                    held.append((node, far))
                    if len(held) > LIGHT:
                        crowded = True
                        out.extend([(True, line, v) for v, _ in held])
                        held.clear()
            yield made()
        pairs()
        yield made()

    dealt = classes.select("node", "embedding").mapInArrow(deal, "line long, salt int, node long, far float")
    dealt = dealt.repartition("line", "salt").sortWithinPartitions("line", "salt", "far", "node")
    counted = dealt.mapInArrow(meet, "crowded boolean, u long, v long").groupBy("crowded", "u", "v").agg(F.count("*").alias("n"))
    # a pair's length isn't known here: what is one collision too few for its length goes at the check
    found = C.checkpoint(counted)

    # crowded line ends: homes, and which of them share an end
    stand = found.where("crowded").select(F.col("u").alias("line"), F.col("v").alias("node"))
    sizes = stand.groupBy("line").agg(F.count("*").alias("size"))
    home = C.heavy_join(stand, sizes, ["line"], "size").groupBy("node").agg(F.max(F.struct("size", "line")).alias("h")).select("node", F.col("h.line").alias("home"))
    home = C.checkpoint(home)
    members = home.groupBy("home").agg(F.count("*").alias("members"))
    block = max(1, BLOCK_BYTES // (8 * max(1, width or 1)))
    # some blocks for every crowd, and none larger than that
    members = members.withColumn("blocks", F.ceil(F.col("members") / F.least(F.lit(block), F.greatest(F.lit(LIGHT), F.ceil(F.col("members") / 16)))).cast("int"))
    met = stand.join(home, "node").select("line", "home").distinct()
    beside = met.withColumnRenamed("home", "a").join(met.withColumnRenamed("home", "b"), "line").where("a <= b").select("a", "b").distinct()
    beside = C.checkpoint(beside)
    both = beside.join(members.select(F.col("home").alias("a"), F.col("blocks").alias("x")), "a").join(members.select(F.col("home").alias("b"), F.col("blocks").alias("y")), "b")
    # what the members of block i of home a have to be sent to: (a, i, b, j), or (b, j, a, i)
    to_b = both.select(F.col("a").alias("home"), F.struct("a", "b", "y", F.lit(True).alias("side")).alias("t"))
    to_a = both.where("a < b").select(F.col("b").alias("home"), F.struct("a", "b", F.col("x").alias("y"), F.lit(False).alias("side")).alias("t"))
    targets = to_b.unionByName(to_a).groupBy("home").agg(F.collect_list("t").alias("t")).join(members, "home")
    sent = C.heavy_join(home.join(classes.select("node", "head", "many", "embedding"), "node"), targets, ["home"], "members")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("t", F.explode("t")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t.y") - 1)))
    same = F.col("t.a") == F.col("t.b")
    i = F.when(same, F.least("own", "o")).when(F.col("t.side"), F.col("own")).otherwise(F.col("o"))
    j = F.when(same, F.greatest("own", "o")).when(F.col("t.side"), F.col("o")).otherwise(F.col("own"))
    side = F.when(same, F.col("own") > F.col("o")).otherwise(F.col("t.side"))
    sent = sent.select(F.col("t.a").alias("a"), i.alias("i"), F.col("t.b").alias("b"), j.alias("j"), side.alias("side"), "node", "head", "many", "embedding")
    dense = C.checkpoint(sent.groupBy("a", "i", "b", "j").applyInArrow(lambda t: _links(t, threshold), "node long, n long, head long, to long"))

    # all other pairs
    pairs = found.where("NOT crowded").select("u", "v", "n")
    for c in ("u", "v"):
        pairs = pairs.join(home.select(F.col("node").alias(c), F.col("home").alias(f"home_{c}")), c, "left")
    done = beside.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    pairs = pairs.withColumn("lo", F.when(F.col("home_v").isNotNull(), F.least("home_u", "home_v"))).withColumn("hi", F.when(F.col("home_u").isNotNull(), F.greatest("home_u", "home_v")))
    known = F.col("home_u").isNotNull() & F.col("home_v").isNotNull()
    apart = pairs.where(~known).unionByName(pairs.where(known).join(done, ["lo", "hi"], "left_anti")).select("u", "v", "n")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v", "head_u", "head_v", "many_u", "many_v"]
        for b in batches:
            x, y = b.column("x"), b.column("y")
            ok = np.zeros(b.num_rows, bool)
            size, other, n = (z.to_numpy(zero_copy_only=False) for z in (x.value_lengths(), y.value_lengths(), b.column("n")))
            for k in np.unique(size[size == other]):
                at = np.flatnonzero((size == k) & (other == k) & (n >= plan.of(int(k))[2]))
                if len(at):
                    p, q = (_units(z.take(pa.array(at)), int(k)) for z in (x, y))
                    ok[at] = (p * q).sum(1) >= threshold
            yield b.select(names).filter(pa.array(ok))

    fetched = apart
    for c, name in (("u", "x"), ("v", "y")):
        fetched = fetched.join(classes.select(F.col("node").alias(c), F.col("head").alias(f"head_{c}"), F.col("many").alias(f"many_{c}"), F.col("embedding").alias(name)), c)
    links = fetched.select("u", "v", "head_u", "head_v", "many_u", "many_v", "n", "x", "y").mapInArrow(verify, "u long, v long, head_u long, head_v long, many_u long, many_v long")
    links = C.checkpoint(links)

    totals = dense.select("node", "n").unionByName(links.select(F.col("u").alias("node"), F.col("many_v").alias("n"))).unionByName(links.select(F.col("v").alias("node"), F.col("many_u").alias("n")))
    totals = totals.groupBy("node").agg(F.sum("n").alias("n"))
    label = components(dense.select(F.col("head").alias("u"), F.col("to").alias("v")).unionByName(links.select(F.col("head_u").alias("u"), F.col("head_v").alias("v"))))
    named = classes.select("node", "head", "many", "h1", "h2").join(totals, "node", "left").join(label.withColumnRenamed("node", "head"), "head", "left")
    named = named.select("h1", "h2", "many", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    ids = rows.select("vec_id", "good", "h1", "h2")
    fine = C.heavy_join(ids.where("good"), named, ["h1", "h2"], "many", total).select("vec_id", "n_links", "component_id")
    rest = ids.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
