"""The census of keys between chunks: rows and steps grow with the keys, not with chunks times buckets."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framescore.llm import chunks as C
from framescore.llm import jaccard
from framescore.llm.components import components


def test_rows_follow_the_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    none = np.zeros(len(keys), bool)
    for buckets in (1, 7, 1000, 10**6, 2**31 - 1):  # as many as a corpus of any size has; a loop over them wouldn't end
        t = C.census_rows(4, keys, None, none, buckets)
        assert t.num_rows <= min(buckets, len(keys)) and sum(len(k) for k in t.column("keys").to_pylist()) == 8 * len(keys)
        assert t.column("bucket").to_pylist() == sorted(set(t.column("bucket").to_pylist()))
        for b, k in zip(t.column("bucket").to_pylist(), t.column("keys").to_pylist(), strict=True):
            assert all(int(x) >> 32 in range(-(-(b << 32) // buckets), -(-((b + 1) << 32) // buckets)) for x in np.frombuffer(k, np.uint64))
    assert C.census_rows(4, keys[:0], None, none[:0], 9).num_rows == 0


def test_eight_times_the_data_gives_eight_times_the_rows():
    """Chunks of one size, with as many buckets as their number asks for."""
    rng, rows = np.random.default_rng(5), []
    for chunks in (50, 400):
        buckets = 400 * chunks
        rows.append(sum(C.census_rows(c, np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)), None, np.zeros(300, bool), buckets).num_rows for c in range(chunks)))
    assert rows[1] <= 9 * rows[0]


def test_replies_go_to_their_keys():
    rng = np.random.default_rng(4)
    for buckets in (1, 5, 64, 12_345):
        keys = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
        bit = rng.random(len(keys)) < 0.3
        sent = C.census_rows(0, keys, None, bit, buckets)
        order = rng.permutation(sent.num_rows)
        reply = pa.table({"bucket": sent.column("bucket"), "bits": sent.column("twice")}).take(pa.array(order))
        assert (C.replied(reply, keys, buckets) == bit).all()
        if len(order) > 1:  # a bucket that sends nothing back has no repeated key
            some = C.replied(reply.slice(1), keys, buckets)
            assert not (some & ~bit).any()


def test_heavy_join_is_plain_without_heavy_keys(spark, monkeypatch):
    """Only keys that could fill a task are broadcast; where there are none, the driver has no more to plan than for one join."""
    rows = spark.range(4000).selectExpr("CASE WHEN id < 2500 THEN 7 WHEN id < 2600 THEN NULL ELSE id END AS k", "id % 5 AS j", "id AS v")
    one = rows.groupBy("k", "j").agg(F.count("*").alias("c"), F.max("v").alias("top"))
    want = sorted(map(tuple, rows.join(one, ["k", "j"]).collect()))
    plain = C.heavy_join(rows, one, ["k", "j"], "c")
    assert "Union" not in (shown := plain._jdf.queryExecution().optimizedPlan().toString()) and shown.count("Join") == 1
    assert sorted(map(tuple, plain.collect())) == want and plain.columns == ["k", "j", "v", "c", "top"]
    monkeypatch.setattr(C, "LIGHT", 400)
    dealt = C.heavy_join(rows, one, ["k", "j"], "c", 4000)
    assert "Union" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == want and dealt.columns == plain.columns
    none = rows.where("v < 0")
    assert not C.heavy_join(none, one.where("c < 0"), ["k", "j"], "c").count()


def jobs(spark, run):
    """Jobs that ``run`` starts."""
    group = f"group-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_near_duplicates_take_few_jobs(spark):
    """Each job, exchange and broadcast costs the driver threads and memory, whatever its size: what was counted while a table was written isn't counted again."""
    texts = [" ".join(f"w{(i * 7 + k) % 997}" for k in range(60)) for i in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 40] + (" more" if i >= 40 else "")) for i in range(80)], "doc_id long, text string").coalesce(1)
    found = []
    assert jobs(spark, lambda: found.extend(jaccard.jaccard_components(docs, 5, 80, 100).collect())) <= 110
    assert {r.doc_id: r.component_id for r in found} == {i: i % 40 for i in range(80)}


def test_components_of_stars_take_no_round(spark):
    """Links of one task leave it as stars; before, a round of four exchanges and four broadcasts followed in any case."""
    links = spark.createDataFrame([(i, i // 10 * 10) for i in range(1000)], "u long, v long").coalesce(1)
    made = []
    assert jobs(spark, lambda: made.append(components(links))) <= 6
    assert {r.node: r.component for r in made[0].collect()} == {i: i // 10 * 10 for i in range(1000) if i % 10}


def test_components_by_windows_and_by_heavy_joins(spark, monkeypatch):
    """Both forms of a round give the same, a node with very many links included."""
    path = [(i, i + 1) for i in range(1, 120)]
    hub = [(i, 5000) for i in range(3000, 3400)]
    links = spark.createDataFrame(path + hub, "u long, v long").repartition(16)
    want = {i: 1 for i in range(2, 121)} | {i: 3000 for i in [*range(3001, 3400), 5000]}
    assert {r.node: r.component for r in components(links).collect()} == want
    monkeypatch.setattr(C, "LIGHT", 20)
    monkeypatch.setattr(C, "HEAVY", 100)
    assert {r.node: r.component for r in components(links).collect()} == want
    assert not components(links.where("u < 0")).count()


def test_checkpoint_measures_what_it_writes(spark):
    rows = spark.range(100).selectExpr("id", "IF(id < 90, id % 7, NULL) AS k")
    found = C.checkpoint(rows.groupBy("k").agg(F.count("*").alias("c")), n=F.count("*"), most=F.max("c"), total=F.sum("c"))
    assert found.measured == {"n": 8, "most": 13, "total": 100}
    assert C.checkpoint(rows.where("id < 0"), n=F.count("*"), most=F.max("k")).measured == {"n": 0, "most": None}
    assert C.checkpoint(rows).measured == {}
    one = found.withColumnRenamed("c", "many")
    assert not jobs(spark, lambda: C.heavy_join(rows, one, ["k"], "many", 100, 13)) and not jobs(spark, lambda: C.heavy_join(rows, one, ["k"], "many", most=13))
