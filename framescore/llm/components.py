"""Connected components of a table of links, by rounds of star contraction.

Links never come to the driver.  First each task contracts the links it holds to a
spanning forest, then large-star and small-star rounds (each a grouped minimum joined back) point
every node at a smaller one until all that is left is stars.  Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import checkpoint, heavy_join, is_light


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task as links of each node to the smallest it reaches."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for i in range(0, len(pairs), 100_000):
        u, v = zip(*pairs[i : i + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reached, of each node of ``links`` (u, v) that isn't its own smallest.

    Rounds go on until every node has one link, to a node without any.  A node that very many link to is joined by ``heavy_join``;
    where there is none, each node's rows meet in a window, which takes half the exchanges.
    """
    now = checkpoint(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").mapInArrow(forest, "u long, v long").distinct())
    while True:
        end = lambda c, starts: F.struct(F.col(c).alias("node"), F.lit(starts).alias("starts"))
        nodes = now.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).groupBy("e.node").agg(F.count("*").alias("c"), F.sum("e.starts").alias("starts"))
        unsettled, most, total = nodes.agg(F.count_if(F.expr("starts > 1 OR starts > 0 AND c > starts")), F.max("c"), F.sum("c")).first()
        if not unsettled:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        light, lowest = is_light(most, total), F.min("v").over(Window.partitionBy("u"))
        # large star: larger neighbours point at the smallest neighbour
        if light:
            large = both.withColumn("m", F.least(lowest, "u"))
        else:
            large = heavy_join(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), ["u"], "c", total, most)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself do so; each node has few of these
        if light:
            small = large.withColumn("m", lowest)
        else:
            large = large.distinct()
            small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")))
        now = checkpoint(small.select(F.explode(pairs).alias("e")).select("e.*").where("u != v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
