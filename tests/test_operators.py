"""Small cases of the expressions and operators, with known values or a plain Python version."""

import itertools
import json
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.functions import parsing as P
from framescore.functions import scoring as S
from framescore.functions.matching import least_distance
from framescore.operators import corpus, dataset, frames, lengths
from framescore.sources import samples
from framescore.streaming.scoring import stream_advantages

GOOD = "<TYPE>fog:0.4<TYPE_END><INFLUENCE>i<INFLUENCE_END><REASONING>\n r \n<REASONING_END><CONCLUSION>c<CONCLUSION_END><ANSWER>[1.5, 6.0]<ANSWER_END>"


def test_parse_response(spark):
    texts = [GOOD, GOOD.replace("<ANSWER>", ""), "<ANSWER>x<ANSWER_END>" + GOOD, "", GOOD.lower(), GOOD.replace("fog:0.4", "")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(P.parse_response(F.col("t")).alias("b")).collect()
    assert [r.b is not None for r in rows] == [True, False, False, False, True, True]
    assert rows[0].b.reasoning_block == "r" and rows[5].b.type_block == ""


def test_interval(spark):
    cases = {"[1.25, 7.5]": (1.25, 7.5), "from 4.0 to 11.5 sec": (4.0, 11.5), "[6, 12]": (6.0, 12.0), "[9.0, 1.0]": None, "nothing here": None, "start_sec: 1, end_sec: 2": (1.0, 2.0), "2 - 3 s": (2.0, 3.0), "2–3 steps": (2.0, 3.0)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(P.interval(F.col("t")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in rows] == list(cases.values())


def test_profile(spark):
    text = "fog:0.4; a : 1e-1;b:x;c;:0.5; fog:0.4f;d:1:2;e:inf"
    r = spark.createDataFrame([(text,)], "t string").select(P.parse_profile(F.col("t")).alias("p")).first()
    assert [tuple(e) for e in r.p] == [("fog", 0.4), ("a", 0.1), ("", 0.5)]


def _best(p, g, w):
    """Assignment by trying all."""
    total, count = 0.0, 0
    for n in {x for x, _ in p} & {x for x, _ in g}:
        a, b = [s for x, s in p if x == n], [s for x, s in g if x == n]
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        total += max(sum(1 - w * abs(x - y) for x, y in zip(a, q, strict=True)) for q in itertools.permutations(b, len(a)))
        count += len(a)
    if not p and not g:
        return 1.0
    return total / max(1, count) - 0.3 * (len(p) - count) - 0.3 * (len(g) - count)


def test_observation_reward_is_the_best_assignment(spark):
    r = random.Random(3)
    make = lambda: [(r.choice("ab"), round(r.random(), 2)) for _ in range(r.randint(0, 5))]
    cases = [(i, make(), make()) for i in range(150)]
    rows = spark.createDataFrame(cases, f"i int, p {P.PROFILE_TYPE}, g {P.PROFILE_TYPE}").select("i", S.reward_observation(F.col("p"), F.col("g")).alias("r")).collect()
    for row in rows:
        assert row.r == pytest.approx(_best(cases[row.i][1], cases[row.i][2], 0.5))
    table = spark.createDataFrame(cases, f"i int, p {P.PROFILE_TYPE}, g {P.PROFILE_TYPE}").select("i", S.reward_observation(F.col("p"), F.col("g"), heaps=False).alias("r"))
    assert {x.i: pytest.approx(x.r) for x in table.collect()} == {x.i: x.r for x in rows} and "Python" not in table._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        S.RewardWeights(severity=-1)


def test_tiou_and_length_reward(spark):
    span = P.INTERVAL_TYPE
    cases = [((1.0, 4.0), (1.0, 4.0), 1.0), ((2.0, 3.0), (7.0, 9.0), 0.0), (None, (1.0, 2.0), 0.0), ((0.0, 3.0), (2.0, 5.0), 0.2)]
    rows = spark.createDataFrame(cases, f"p {span}, g {span}, e double").select(S.tiou(F.col("p"), F.col("g")).alias("t"), "e").collect()
    assert all(r.t == pytest.approx(r.e) for r in rows)
    assert spark.range(1).select(S.reward_length(F.lit(0), F.lit(10))).first()[0] == 0


def test_advantages_average_to_nothing(spark):
    rows = spark.createDataFrame([(i // 4, float(i * i % 7)) for i in range(40)], "g int, r double").select("g", S.advantage(F.col("r"), "g").alias("a"))
    assert all(abs(r.m) < 1e-5 for r in rows.groupBy("g").agg(F.avg("a").alias("m")).collect())


def test_lengths(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices("a b c d. e; f", k=r.randint(0, 40))) for _ in range(60)]
    texts += ["", None, "x " * 400, "one two three. one two three four. " * 3, " ".join(f"w{i};" for i in range(90))]
    df = spark.createDataFrame([(i, t, (t or "").lower().split()) for i, t in enumerate(texts)], "i int, t string, w array<string>")
    cut = df.withColumn("c", F.col("w"))
    for n in (3, 4, 5):
        cut = spark.createDataFrame(cut.withColumn("c", lengths.without_repeats_column(F.col("c"), n)).collect(), cut.schema)
    found = cut.select("w", "c", lengths.effective_length("t").alias("n")).collect()
    for row in found:  # the fold of the cuts, then clauses one by one
        kept: list[list[str]] = []
        for part in "".join(x if x not in ".!?;" else "\n" for x in " ".join(row.c)).split("\n"):
            words = part.split()
            if words and not any(len({*words} & {*k}) / len({*words} | {*k}) >= 0.85 for k in kept):
                kept.append(words)
        assert row.n == min(len(row.w), sum(map(len, kept[:50])))
    repeated = spark.createDataFrame([("p q r s p q r t".split(),)], "w array<string>")
    assert repeated.select(lengths.without_repeats_column(F.col("w"), 3).alias("o")).first().o == ["p", "q", "r", "s", "t"]


def test_meteor_and_cider(spark):
    assert corpus.meteor_of("", "a") == 0 and corpus.meteor_of("a b c", "a b c") == pytest.approx(1 - 0.5 / 27)
    assert corpus.meteor_of("walked home", "walking home") > 0.9
    one = spark.createDataFrame([(1, "a b", "a b")], "id long, hyp string, ref string")
    assert corpus.cider(one).first()[0] == 0 and corpus.cider(one.limit(0)).first()[0] == 0


def test_cider_broadcasts_no_ngrams(spark, tmp_path):
    """Against a plain version, ids that repeat and null texts too; n-grams are joined by a shuffle, however small the files."""
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefg") for _ in range(r.randrange(12)))
    rows = [(i // 2 if i < 8 else i, text(), text()) for i in range(60)] + [(70, None, "a b"), (71, "a b", None), (None, "a c d", "a c")]
    spark.createDataFrame(rows, "id long, hyp string, ref string").coalesce(1).write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    met = {}
    for i, h, t in rows:
        for side, x in enumerate((h, t)):
            w = (x or "").split()
            for n in range(1, 5):
                for k in range(len(w) - n + 1):
                    met.setdefault((i, n), {}).setdefault(tuple(w[k : k + n]), [0, 0])[side] += 1
    df = Counter(g for c in met.values() for g, x in c.items() if x[1])
    total = 0
    for c in met.values():
        v = np.array([np.array(x) * np.log((len(rows) + 1) / (df[g] + 1)) for g, x in c.items()])
        total += (v[:, 0] * v[:, 1]).sum() / ((np.sqrt((v[:, 0] ** 2).sum()) + 1e-9) * (np.sqrt((v[:, 1] ** 2).sum()) + 1e-9))
    found = corpus.cider(pairs)
    assert found.first()[0] == pytest.approx(total / 4 / len(rows))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_splits_keep_videos_together(spark):
    rows = spark.createDataFrame([(f"vid_{i // 4:03d}_diff{i % 4}",) for i in range(400)], "video_id string")
    s = dataset.split_dataset(rows).withColumn("base", P.base_id(F.col("video_id")))
    assert s.count() == 400 and s.groupBy("base").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = {r.split: r.n for r in s.groupBy("split").agg((F.count("*") / 4).cast("int").alias("n")).collect()}
    assert n == {"sft_train": 21, "rl_train": 49, "val": 15, "test": 15}


def test_samples_from_disk(spark, tmp_path):
    assert samples.load_samples(spark, str(tmp_path), "val").count() == 0
    with pytest.raises(ValueError):
        samples.load_samples(spark, str(tmp_path), "none")
    rows = [{"video_id": "a", "split": "val", "gt_interval": [1, 2], "degradation_profile": [["fog", 0.4]]}, {"video_id": "b", "split": "val"}, {"video_id": "c"}]
    (tmp_path / "annotations.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    (tmp_path / "splits.json").write_text(json.dumps({"b": "test", "c": "val"}))
    got = {r.video_id: r for r in samples.load_samples(spark, str(tmp_path), "val").collect()}
    assert set(got) == {"a", "c"} and got["a"].degradation_profile[0].severity == 0.4 and got["c"].gt_interval.end_sec == 1.0 and got["c"].split == "val"


def test_frames_in_numpy(spark):
    f = np.random.default_rng(1).integers(0, 256, (8, 8, 1), dtype=np.uint8)
    row = spark.createDataFrame([([int(x) for x in f.ravel()],)], "px array<int>")
    c = F.col("px")
    for name, s, native in (("motion_blur", 0.2, frames.motion_blur(c, 0.2, 8, 8)), ("low_light", 0.4, frames.low_light(c, F.lit(0.4))), ("fog", 0.8, frames.fog(c, F.lit(0.8))), ("vehicle_mask", 0.8, frames.occlusion(c, F.lit(0.8), 8, 8)), ("interaction_area_mask", 0.8, frames.occlusion(c, F.lit(0.8), 8, 8, True))):
        assert row.select(native.alias("o")).first().o == frames.degrade_frame(f, [(name, s)], 1).ravel().tolist(), name
    assert (frames.degrade_frame(f, [("unknown", 0.5)], 1) == f).all()
    many = frames.sample_frames([np.zeros((36, 52, 3), np.uint8)] * 41, size=32)
    assert many.shape == (25, 32, 32, 3) and frames.to_tensor(many).shape == (25, 3, 32, 32)
    with pytest.raises(ValueError):
        frames.sample_frames([f] * 3)


def test_stream_of_advantages(spark, tmp_path):
    spark.createDataFrame([(i % 5, i, float(i)) for i in range(18)], "group_id long, member long, reward double").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("group_id long, member long, reward double").parquet(str(tmp_path / "in"))
    q = stream_advantages(rows, 3, timeout_ms=1).writeStream.format("memory").queryName("advantages").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 60
    while time.time() < until and spark.table("advantages").where("advantage IS NULL").count() < 3:
        time.sleep(0.5)
    q.stop()
    got = spark.table("advantages").where("advantage IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("n"), F.sum("advantage").alias("s")).collect()
    assert all(r.n == 3 and abs(r.s) < 1e-6 for r in got) and len(got) == 5
    assert spark.table("advantages").where("advantage IS NULL").count() == 3  # of groups that stay incomplete


def test_flare_and_rain():
    f = np.full((40, 50, 3), 90, np.uint8)
    lit = frames.degrade_frame(f, [("lens_flare", 0.8)], 1)
    assert (lit[0, 0] == f[0, 0]).all() and lit[12, 35, 0] == 133 and lit[12, 35, 2] == 106 and lit[12, 35, 0] >= lit[12, 40, 0]
    wet = frames.degrade_frame(f, [("rain_snow", 0.5)], 1)
    streaks = wet[(wet != f).any(2)]
    assert len(streaks) > 200 and streaks.min() >= 180 and (frames.degrade_frame(f, [("rain_snow", 0.5)], 1) == wet).all()
    assert (frames.degrade_frame(f, [("lens_flare", 0.0), ("rain_snow", 0.0)], 1) == f).all()


def test_strict_quarantine_and_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("v", 0.2, (0.0, 1.0), *["x"] * 5)], f"video_id string, difficulty_level double, gt_interval {P.INTERVAL_TYPE}, {', '.join(f'{t} string' for t in samples.TEXTS)}")
    assert samples.read_clip_annotations(spark, str(tmp_path / "none.json")).count() == 0
    assert dataset.quarantine(rows, dataset.valid_sample(), strict=True)[0].count() == 1
    strict, _ = dataset.quarantine(rows.withColumn("answer_annotation", F.lit("")), dataset.valid_sample(), strict=True)
    with pytest.raises(Exception, match="isn't valid"):
        strict.collect()
    samples.write_results(rows.select("video_id", F.lit(None).cast("string").alias("note")), str(tmp_path / "out"))
    assert '"note":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_frames_of_clips(spark):
    clips = spark.createDataFrame([("a", [bytes(range(12))] * 26, 2, 2, 3, [("fog", 0.4)]), ("b", [b"123"], 2, 2, 3, [("fog", 0.4)])], f"video_id string, frames array<binary>, height int, width int, channels int, degradation_profile {P.PROFILE_TYPE}")
    a, b = frames.degrade_clips(clips).orderBy("video_id").collect()
    assert a.frames[3] == frames.degrade_frame(np.arange(12, dtype=np.uint8).reshape(2, 2, 3), [("fog", 0.4)], 0).tobytes() and a.error is None
    assert b.frames is None and b.error
    a, b = frames.sample_clips(clips, size=4).orderBy("video_id").collect()
    assert len(a.frames) == 25 and len(a.frames[0]) == 48 and a.height == 4 and b.frames is None
    t = frames.tensor_clips(clips.where("video_id = 'a'")).first()
    assert t.shape == [26, 3, 2, 2] and len(t.tensor) == 312 and t.tensor[1] == pytest.approx(3 / 255)
    back = frames.bytes_of_tensors(frames.tensor_clips(clips).select("video_id", "tensor", "shape")).orderBy("video_id").collect()
    assert (back[0].height, back[0].width, back[0].channels) == (2, 2, 3) and back[0].frames == [frames.from_tensor(frames.to_tensor(np.arange(12, dtype=np.uint8).reshape(1, 2, 2, 3)))[0].tobytes()] * 26
    assert back[1].frames is None and back[1].error


def test_meteor_takes_few_chunks_and_pairs_go_by_place(spark):
    assert corpus.meteor_of("a b a c", "x a c a b") == pytest.approx(corpus.meteor_of("p q r s", "z r s p q"))
    assert corpus.meteor_of("relational ponies", "relate pony") > 0.5
    x, y = spark.range(0, 50, 1, 7), spark.range(100, 130, 1, 3)
    got = corpus.paired(x.withColumnRenamed("id", "p"), y.withColumnRenamed("id", "r")).collect()
    assert sorted((r.sample_id, r.p, r.r) for r in got) == [(i, i, 100 + i) for i in range(30)]
    corpus.register(spark)
    assert spark.sql("SELECT lcs(array('a', 'b', 'c'), array('b', 'x', 'c')) AS n, effective_length('one two') AS e").first() == (2, 2)


def test_matching_on_a_line(spark):
    r = random.Random(1)
    for _ in range(2000):
        a, b = ([r.randint(0, 9) / 10 for _ in range(r.randint(0, 6))] for _ in range(2))
        short, long = sorted((a, b), key=len)
        assert least_distance(a, b) == pytest.approx(min(sum(abs(x - y) for x, y in zip(short, q, strict=True)) for q in itertools.permutations(long, len(short))))
    # ten thousand of one name, against the table row by row
    p, g = sorted(r.random() for _ in range(10_000)), sorted(r.random() for _ in range(12_000))
    row = np.zeros(2001)
    for i, x in enumerate(p):
        row = np.minimum.accumulate(row) + np.abs(x - np.array(g[i : i + 2001]))
    one = spark.createDataFrame([([("fog", x) for x in p], [("fog", x) for x in g])], f"p {P.PROFILE_TYPE}, g {P.PROFILE_TYPE}")
    assert one.select(S.reward_observation(F.col("p"), F.col("g")).alias("r")).first().r == pytest.approx((10_000 - 0.5 * row.min()) / 10_000 - 0.3 * 2000)


def test_places_come_from_one_evaluation(spark):
    """Another order and other partitions each time that the rows are evaluated."""
    rows = spark.range(0, 3000, 1, 9).orderBy(F.rand()).coalesce(3).withColumn("drawn", F.rand())
    got = corpus.numbered(rows, "at").collect()
    assert sorted(r.at for r in got) == list(range(3000)) and sorted(r.id for r in got) == list(range(3000))
    assert corpus.numbered(spark.range(0)).count() == 0
    pairs = corpus.paired(rows.select(F.col("id").alias("p")), rows.select(F.col("id").alias("r"))).collect()
    assert sorted(x.sample_id for x in pairs) == list(range(3000)) and len({x.p for x in pairs}) == len({x.r for x in pairs}) == 3000


def test_windows_as_single_integers():
    """Windows are numbered without sorting rows of ids; equal windows have equal numbers, those too whose digits don't fit 63 bits."""
    import random

    import numpy as np

    from framescore.operators import lengths

    r = random.Random(3)
    for n in (3, 4, 5):
        for top in (3, 1 << 20):
            ids = np.array([r.choice([0, 1, 2, top, r.randint(0, top)]) for _ in range(300)])
            number, count = lengths._numbered(ids, n)
            windows = [tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1)]
            assert len(number) == len(windows) and len(set(zip(windows, number.tolist(), strict=True))) == len(set(windows)) == len(count)
            assert all(count[k] == windows.count(w) for w, k in zip(windows, number.tolist(), strict=True))


def test_bundle_broadcasts_no_ngrams(spark):
    """The metric bundle takes CIDEr by its own step, in which n-grams aren't broadcast."""
    from framescore.plans import registry

    plan = registry.QUERIES["eval_bundle_full"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
