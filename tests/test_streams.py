"""Advantages of a stream by keyed state: repeats, late rows, groups that stay incomplete, a restart."""

import time

import pytest
from pyspark.sql import functions as F

from framescore.functions import scoring as S
from framescore.streaming import advantages as A

SCHEMA = "group_id long, member long, reward double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def _run(spark, tmp_path, timeout_ms):
    rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    found = A.advantages_by_member(rows, 3, timeout_ms)
    return found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))


def _catch_up(spark, tmp_path, n):
    """Runs the stream until so many more rows are taken, and stops it; the next run starts from its checkpoint.

    With timers to come, batches without data never end, so there is nothing else to wait for.
    """
    q = _run(spark, tmp_path, 3_600_000).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and sum(p["numInputRows"] for p in q.recentProgress) < n:
        time.sleep(0.2)
    q.stop()


def _put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_repeats_late_rows_and_a_restart(rocks, tmp_path):
    spark = rocks
    reward = lambda g, m: float((7 * g + 5 * m) % 11)
    _put(spark, tmp_path, [(g, m, reward(g, m)) for g in range(5) for m in range(2)] + [(0, 1, 99.0), (0, 0, 98.0)])
    _catch_up(spark, tmp_path, 12)
    assert spark.read.schema(A.OUT).parquet(str(tmp_path / "out")).count() == 0
    # after a restart: repeats again, a third member of four groups, and a fourth one that is too late
    _put(spark, tmp_path, [(g, 1, 97.0) for g in range(5)] + [(g, 2, reward(g, 2)) for g in range(4)])
    _catch_up(spark, tmp_path, 9)
    _put(spark, tmp_path, [(0, 3, 50.0), (0, 2, 96.0), (1, 0, 95.0)])
    _catch_up(spark, tmp_path, 3)
    found = spark.read.schema(A.OUT).parquet(str(tmp_path / "out"))
    kept, late = A.without_late(found)
    table = spark.createDataFrame([(g, m, reward(g, m)) for g in range(4) for m in range(3)], SCHEMA)
    want = {(r.group_id, r.member): (r.reward, pytest.approx(r.a)) for r in table.withColumn("a", S.advantage(F.col("reward"), "group_id")).collect()}
    assert {(r.group_id, r.member): (r.reward, r.advantage) for r in kept.collect()} == want and kept.count() == 12
    assert [tuple(r) for r in late.collect()] == [(0, 3, 50.0, None, A.LATE)]


def test_groups_that_stay_incomplete(rocks, tmp_path):
    spark = rocks
    _put(spark, tmp_path, [(7, 1, 1.0), (7, 1, 2.0), (8, 1, 3.0), (8, 2, 4.0), (8, 3, 5.0)])
    q = _run(spark, tmp_path, 1).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 90
    out = lambda: [tuple(r) for r in spark.read.schema(A.OUT).parquet(str(tmp_path / "out")).where("group_id = 7").collect()] if (tmp_path / "out").exists() else []
    while time.time() < until and not out():
        time.sleep(0.5)
    q.stop()
    assert out() == [(7, 1, 1.0, None, A.TIMED_OUT)]
