"""Videos as a data source and the staged build: what is read, decoded and called how often, and what fails on the way."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.operators import dataset
from framescore.operators import frames as V
from framescore.sources import samples, stages, videos

H, W, C = 2, 3, 3


def clip(seed: int, n: int) -> list[bytes]:
    return [bytes((seed + i + j) % 256 for j in range(H * W * C)) for i in range(n)]


def Counting(log: str):
    """A codec that leaves a line for each frame it reads."""

    class Codec(videos.RawCodec):
        def open(self, file):
            found = super().open(file)
            plain = found.read

            def read(places):
                for px in plain(places):
                    with open(f"{log}.{os.getpid()}", "a") as f:
                        f.write("x\n")
                    yield px

            found.read = read
            return found

    return Codec()


def count(log) -> int:
    return sum(len(p.read_text().split()) for p in log.parent.glob(log.name + ".*"))


@pytest.fixture
def folder(spark, tmp_path):
    """Six videos in two folders, one of them short, one damaged, one no video at all; a text besides."""
    a, b = tmp_path / "a", tmp_path / "b"
    rows = [(f"v{i}", clip(i, 3 if i == 4 else 30 + i), H, W, C) for i in range(5)]
    videos.write_clips(spark.createDataFrame(rows[::-1], videos.CLIP).repartition(3), f"file://{a}")
    b.mkdir()
    (b / "v5.mp4").write_bytes((a / "v1.mp4").read_bytes()[:-5])
    (b / "v6.mp4").write_bytes(b"nothing")
    (b / "notes.txt").write_text("no video")
    (a / "below").mkdir()
    (a / "below" / "v9.mp4").write_bytes((a / "v1.mp4").read_bytes())
    return [f"file://{a}", str(b)]


def test_scan_of_videos(spark, folder, tmp_path):
    log = tmp_path / "log"
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["below", *(f"v{i}.mp4" for i in range(5))]
    df = videos.read_frames(spark, folder, Counting(str(log)), frames=25)
    rows = df.collect()
    assert count(log) == 4 * 25 + 24  # of the one that breaks off, the last is missing
    good = [r for r in rows if r.error is None]
    assert [(r.video_id, r.frame_idx) for r in good] == [(f"v{i}", k) for i in range(4) for k in range(25)]  # by name, as listed
    for r in good:
        n = 30 + int(r.video_id[1:])
        assert (r.given, r.n_frames, r.height, r.width, r.channels) == (25, n, H, W, C) and r.place == int(r.frame_idx * (n - 1) / 24)
        assert r.px == clip(int(r.video_id[1:]), n)[r.place]
    assert {r.video_id: r.error for r in rows if r.error} == {"v4": "3 frames, 25 are needed", "v5": "frame 30 breaks off", "v6": "not a raw clip"}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_whole_videos_in_runs_and_heads_alone(spark, folder, tmp_path):
    size = os.path.getsize(tmp_path / "a" / "v3.mp4")
    whole = videos.read_frames(spark, folder, partitionBytes=size // 4)
    assert whole.rdd.getNumPartitions() > 16
    rows = whole.where("error IS NULL AND video_id < 'v5'").orderBy("video_id", "frame_idx").collect()
    assert [(r.video_id, r.px) for r in rows] == [(f"v{i}", px) for i in range(4) for px in clip(i, 30 + i)] and all(r.place == r.frame_idx for r in rows)
    assert sorted({(r.video_id, r.error) for r in whole.where("error IS NOT NULL").collect()}) == [("v4", "3 frames, 25 are needed"), ("v5", "frame 30 breaks off"), ("v6", "not a raw clip")]
    log = tmp_path / "heads"
    heads = videos.read_frames(spark, folder, Counting(str(log)), pixels=False).collect()
    assert count(log) == 0 and [(r.video_id, r.n_frames, r.px) for r in heads if not r.error] == [*((f"v{i}", 30 + i, None) for i in range(4)), ("v5", 31, None)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert videos.read_frames(spark, [str(empty)]).count() == 0


def test_filters_keep_files_closed(spark, folder, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        log = tmp_path / "log"
        got = videos.read_frames(spark, folder, Counting(str(log)), frames=25).where("video_id IN ('v1', 'v2', 'v9') AND video_id <> 'v2'")
        assert [(r.video_id, r.frame_idx) for r in got.collect()] == [("v1", k) for k in range(25)] and count(log) == 50
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_list_of_videos_reads_no_bytes(spark, folder):
    df = samples.list_videos(spark, [f for f in folder])
    assert [r.video_id for r in df.collect()] == [f"v{i}" for i in range(7)] and df.columns == ["video_id", "path", "length"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_whole_files_through_a_decoder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"v{i}.mp4").write_bytes(bytes([i]) * (3 if i == 2 else 30))

    def decode(raw: bytes) -> list[bytes]:
        if raw[0] == 1:
            raise RuntimeError("no such codec")
        return [bytes([b] * 12) for b in raw]

    found = samples.decode_videos(samples.video_bytes(spark, [str(tmp_path)]), decode, 2, 2)
    assert found.schema == videos.read_frames(spark, [str(tmp_path)]).schema
    rows = found.collect()
    assert {r.video_id: r.error for r in rows if r.error} == {"v1": "no such codec", "v2": "3 frames, 25 are needed"}
    assert [(r.frame_idx, r.px) for r in rows if r.video_id == "v0"] == [(i, bytes(12)) for i in range(30)]


@pytest.fixture
def notes(spark, tmp_path):
    (tmp_path / "clips.json").write_text(json.dumps({"v0": {"start_frame": 9, "end_frame": 2}, "v1": {"start_sec": 0.5, "end_sec": 1.5}}))
    return samples.read_clip_annotations(spark, str(tmp_path / "clips.json"))


def test_build_calls_codec_and_model_once_a_row(spark, folder, notes, tmp_path):
    frames_log, calls = tmp_path / "frames", tmp_path / "calls"

    def answer(prompt: str) -> str:
        with open(f"{calls}.{os.getpid()}", "a") as f:
            f.write("x\n")
        if "low_light (severity=0.8)" in prompt and "reason" in prompt.lower():
            raise RuntimeError("nothing to say")
        return f"  {time.time_ns()} "  # another one each time

    built = dataset.build_dataset(videos.read_frames(spark, folder, Counting(str(frames_log))), notes, dataset.by_row(answer), f"file://{tmp_path}/out")
    rows, failed = built.samples.collect(), built.failures.collect()
    assert count(frames_log) == sum(30 + i for i in range(4)) + 30
    assert count(calls) == 3 * (3 * 5 + 2)  # v1 to v3; at the last level the second call fails, and no third is made
    assert {(r.video_id, r.difficulty_level) for r in rows} == {(f"v{i}", v) for i in (1, 2, 3) for v in dataset.LEVELS[:3]}
    assert sorted((r.video_id, r.difficulty_level, r.error) for r in failed if r.difficulty_level) == [(f"v{i}", 0.8, "nothing to say") for i in (1, 2, 3)]
    assert sorted((r.video_id, r.error) for r in failed if not r.difficulty_level) == [("v0", "the range doesn't run forward"), ("v4", "3 frames, 25 are needed"), ("v5", "frame 30 breaks off"), ("v6", "not a raw clip")]
    # rows that are asked for again are the same rows
    assert sorted(r.answer_annotation for r in built.samples.collect()) == sorted(r.answer_annotation for r in rows) and count(calls) == 51
    assert {r.gt_interval.end_sec for r in rows if r.video_id == "v1"} == {1.5} and all(r.split in samples.SPLITS for r in rows)
    assert not {"px", "frames"} & {*built.samples.columns}
    px = {(r.video_id, r.difficulty_level, r.frame_idx): r.px for r in built.frames.collect()}
    first = np.frombuffer(clip(2, 1)[0], np.uint8).reshape(H, W, C)
    assert px["v2", 0.0, 0] == first.tobytes() and px["v2", 0.4, 0] == V.degrade_frame(first, [("motion_blur", 0.4), ("low_light", 0.4)], 0).tobytes()


def test_build_goes_on_where_it_broke_off(spark, folder, notes, tmp_path):
    calls, out = tmp_path / "calls", f"file://{tmp_path}/out"

    def answer(prompt: str) -> str:
        with open(f"{calls}.{os.getpid()}", "a") as f:
            f.write("x\n")
        return "fine"

    def broken(prompt):
        return F.raise_error(F.lit("the model server is gone")).cast("string")

    frames = videos.read_frames(spark, folder, Counting(str(tmp_path / "frames")))
    with pytest.raises(Exception, match="server is gone"):
        dataset.build_dataset(frames, notes, broken, out)
    read = count(tmp_path / "frames")
    assert read > 0 and not stages.Stages(spark, out).done("annotated")
    built = dataset.build_dataset(frames, notes, dataset.by_row(answer), out)
    assert built.samples.count() == 12 and count(tmp_path / "frames") == read and count(calls) == 60
    again = dataset.build_dataset(frames, notes, broken, out)
    assert again.samples.count() == 12 and count(calls) == 60


def test_model_sees_frames(spark, folder, notes, tmp_path):
    def answer(prompt: str, seen) -> str:
        return ",".join(str(f[0]) for f in seen) or "none"

    built = dataset.build_dataset(videos.read_frames(spark, folder, frames=25), notes, dataset.by_row(answer), f"file://{tmp_path}/out", see=3)
    got = {r.video_id: r for r in built.samples.where("difficulty_level = 0").collect()}
    for i in (1, 2, 3):
        held = [clip(i, 30 + i)[k * (29 + i) // 24] for k in range(25)]
        assert got[f"v{i}"].answer_annotation == ",".join(str(held[k][0]) for k in (0, 12, 24)) and got[f"v{i}"].reasoning_annotation == "none"
    assert built.frames.where("video_id = 'v1' AND difficulty_level = 0.2").count() == 25


def test_only_one_split_is_read(spark, folder, notes, tmp_path):
    built = dataset.build_dataset(videos.read_frames(spark, folder, frames=25), notes, lambda p: F.lit("fine"), f"file://{tmp_path}/out")
    one = dataset.load_built(spark, f"file://{tmp_path}/out", "rl_train")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert one.count() == built.samples.where("split = 'rl_train'").count()
    read = one.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.rsplit("/", 2)[1] for r in read} == {"split=rl_train"}
    with pytest.raises(ValueError):
        dataset.load_built(spark, f"file://{tmp_path}/out", "none")
    shown = dataset.with_pixels(one, built.frames).collect()
    assert shown and all(len(r.frames) == 25 and r.frames[0] == {(x.path, x.difficulty_level): x.px for x in built.frames.where("frame_idx = 0").collect()}[r.path, r.difficulty_level] for r in shown)


def test_many_small_files_are_dealt_out(tmp_path):
    """Each file counts for more than its bytes, so that no task opens very many; a few files too are read by several tasks."""
    for i in range(1200):
        (tmp_path / f"v{i:04d}.mp4").write_bytes(b"x" * 100)

    def dealt(tasks):
        return [len(p.files) for p in videos.FrameReader(None, [str(tmp_path)], ".mp4", 25, True, 25, videos.PARTITION_BYTES, tasks).partitions()]

    assert sum(dealt(1)) == sum(dealt(24)) == 1200
    assert len(dealt(1)) > 1 and len(dealt(24)) >= 24 and max(dealt(24)) <= 51


def test_byte_sums(spark):
    from framescore.plans.build import _byte_sum

    rows = spark.createDataFrame([(0, b"\x00\xff\x01"), (1, b""), (2, None), (3, b"\xff" * 300)], "i int, px binary")
    plan = rows.select("i", _byte_sum("px").alias("n"))
    assert [r.n for r in plan.orderBy("i").collect()] == [256, 0, None, 76500]


def test_vectors_are_dealt_out(spark):
    """A small file of vectors, of which videos and frames are made, isn't left to the one task that reads it."""
    from framescore.plans import fixtures

    assert "RoundRobinPartitioning" in fixtures.videos(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
