"""Building a dataset: clips, difficulty profiles, validation, annotation, leakage-free splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing as P
from ..sources.samples import SPLITS, TEXTS
from ..sources.stages import Stages
from . import frames as V

# fixed values: families of observation factors and the levels of difficulty
FACTORS = {"blur": ("motion_blur", "lens_flare", "sensor_noise"), "environment": ("low_light", "rain_snow", "fog", "tunnel_low_light"), "occlusion": ("vehicle_mask", "interaction_area_mask")}
LEVELS = (0.0, 0.2, 0.4, 0.8)


def factor_dim(spark: SparkSession) -> DataFrame:
    """``family`` and ``name`` of the known factors."""
    return spark.createDataFrame([(f, n) for f, names in FACTORS.items() for n in names], "family string, name string")


def profiles(spark: SparkSession) -> DataFrame:
    """One profile a level; that of level 0 has no factor."""
    rows = [(v, [("motion_blur", v), ("low_light", v)] if v else []) for v in LEVELS]
    return spark.createDataFrame(rows, f"difficulty_level double, degradation_profile {P.PROFILE_TYPE}")


def fan_out(clips: DataFrame) -> DataFrame:
    """Each clip with each of the four profiles."""
    known = [F.struct(F.lit(v).alias("difficulty_level"), (F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("severity")) for n in ("motion_blur", "low_light"))) if v else F.array().cast(P.PROFILE_TYPE)).alias("degradation_profile")) for v in LEVELS]
    return clips.select("*", F.inline(F.array(*known)))


def clip_defaults(clips: DataFrame, annotations: DataFrame, fps: float = 30.0) -> DataFrame:
    """Clips with frame and second ranges, from their annotation or else the whole clip (``n_frames``)."""
    return clips.join(annotations, "video_id", "left").select(
        *(c for c in clips.columns),
        F.coalesce("start_frame", F.lit(0)).alias("start_frame"),
        F.coalesce("end_frame", F.col("n_frames") - 1).alias("end_frame"),
        F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"),
        F.coalesce("end_sec", F.col("n_frames") / fps).alias("end_sec"),
    )


def valid_sample(level: str = "difficulty_level", span: str = "gt_interval", texts: tuple[str, ...] = TEXTS) -> Column:
    """Level is known, the interval runs forward and no annotation is blank; never null."""
    ok = F.col(level).isin(*LEVELS) & (F.col(f"{span}.start_sec") < F.col(f"{span}.end_sec"))
    for t in texts:
        ok = ok & P.not_blank(F.col(t))
    return F.coalesce(ok, F.lit(False))


def quarantine(rows: DataFrame, ok: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that don't; ``strict`` raises on the first that doesn't."""
    if strict:
        return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error("a sample isn't valid").cast("boolean"))), rows.limit(0)
    return rows.where(ok), rows.where(~ok)


def asked(rows: DataFrame, name: str, said: Column) -> DataFrame:
    """Adds ``name``, a generator's text; where it gives (text, error), the first error of a row stays in ``error``."""
    out = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
    out = out.withColumn("__said", said)
    if not isinstance(out.schema["__said"].dataType, T.StructType):
        return out.withColumn(name, F.col("__said")).drop("__said")
    return out.withColumns({name: F.col("__said.text"), "error": F.coalesce("error", "__said.error")}).drop("__said")


def annotate(clips: DataFrame, generate: Callable[..., Column], frames: str | None = None) -> DataFrame:
    """Annotations of degraded clips by a chain of calls of ``generate``, a UDF from prompt to text.

    With ``frames``, the name of a column, it gets that too; rewriting is done without any.  After a failure a row's further prompts are null.
    """
    p, none = F.col("degradation_profile"), F.array().cast("array<binary>")
    call = (lambda prompt, seen: generate(prompt)) if frames is None else generate
    seen = None if frames is None else F.col(frames)
    out = asked(clips, "influence_annotation", call(P.influence_prompt(p), seen))
    out = asked(out, "reasoning_annotation", call(P.reasoning_prompt(p, F.col("influence_annotation")), seen))
    out = asked(out, "conclusion_annotation", call(P.conclusion_prompt(F.col("reasoning_annotation")), seen))
    out = asked(out, "answer_annotation", call(P.answer_prompt(F.col("conclusion_annotation")), seen))
    out = asked(out, "reasoning_annotation", call(P.compactness_prompt(F.col("reasoning_annotation"), P.mean_severity(p)), none))
    return out.withColumn("type_annotation", P.profile_text(p))


def sample_group(prompts: DataFrame, generate: Callable[[Column], Column], n: int = 4) -> DataFrame:
    """``n`` responses of each prompt."""
    return asked(prompts.withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(n)))), "response", generate(F.col("prompt")))


def split_dataset(samples: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``split`` by source video, so that all variants of one are together.

    70 % of the ids train, 15 % validate, the rest test; of training ids 30 % are for the supervised
    stage.  Ids are ranked by a hash.  Ranks are made within 256 hash ranges and shifted by the
    ranges' counts, so no task orders all ids.
    """

    def ranked(ids: DataFrame, salt: str, name: str) -> tuple[DataFrame, Column]:
        held = ids.withColumn("h", F.md5(F.concat(F.lit(f"{salt}:"), "base"))).withColumn("part", F.substring("h", 1, 2))
        counts = held.groupBy("part").agg(F.count("*").alias("c"))
        shift = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"))  # 256 rows
        at = F.row_number().over(Window.partitionBy("part").orderBy("h", "base")) + F.col("before")
        return held.join(F.broadcast(shift), "part").withColumn(name, at).drop("h", "part", "before")

    ids = samples.select(P.base_id(F.col("video_id")).alias("base")).distinct()
    first = ranked(ids, str(seed), "k")
    n = F.col("total")
    train, val = F.floor(n * F.lit(0.70)), F.floor(n * F.lit(0.15))
    placed = first.withColumn("part_of", F.when(F.col("k") <= train, "train").when(F.col("k") <= train + val, "val").otherwise("test")).drop("total", "k")
    second = ranked(placed.where("part_of = 'train'").select("base"), f"{seed}:sft", "k")
    second = second.select("base", F.when(F.col("k") <= F.floor(n * F.lit(0.30)), "sft_train").otherwise("rl_train").alias("split"))
    named = second.unionByName(placed.where("part_of != 'train'").select("base", F.col("part_of").alias("split")))
    return samples.drop("split").withColumn("base", P.base_id(F.col("video_id"))).join(named, "base").drop("base")


def by_row(f: Callable[..., str]) -> Callable[..., Column]:
    """``f``, of a prompt and what else a generator gets, as a generator of (text, error).

    What it raises is the row's error, not the job's; a null prompt isn't asked.  It counts as nondeterministic, as models are, so Spark
    calls it once a row and never moves it.
    """

    def one(prompt: str | None, *more) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, None
        try:
            return f(prompt, *more), None
        except Exception as e:  # whatever a model raises; a row's failure is data here, not the job's
            return None, str(e) or type(e).__name__

    def generate(*cols: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(*cols, strict=True)], columns=["text", "error"], dtype=object)

    return F.pandas_udf(generate, "text string, error string").asNondeterministic()


def generate_and_parse(rows: DataFrame, generate: Callable[[Column], Column], prompt: str = "prompt") -> DataFrame:
    """``response`` to each prompt and its ``blocks``, null if it can't be parsed."""
    return asked(rows, "response", generate(F.col(prompt))).withColumn("blocks", P.let(P.parse_response, F.col("response")))


@dataclass(frozen=True)
class Build:
    """What a build wrote: ``samples`` without pixels by split, ``failures`` (video_id, path, difficulty_level, error), and the degraded
    ``frames`` (video_id, path, difficulty_level, frame_idx, given, height, width, channels, px)."""

    samples: DataFrame
    failures: DataFrame
    frames: DataFrame


def collect_clips(decoded: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips of rows of frames (see ``videos.FRAME``) with their ranges, without pixels, and those with an ``error``.

    A clip is left out if any of its frames couldn't be read or its range doesn't run forward.
    """
    broken = decoded.where("error IS NOT NULL").groupBy("path").agg(F.min("video_id").alias("video_id"), F.min("error").alias("error"))
    heads = decoded.where("error IS NULL AND frame_idx = 0").select("video_id", "path", "given", "n_frames", "height", "width", "channels")
    ranged = clip_defaults(heads.join(broken.select("path"), "path", "left_anti"), annotations)
    good, bad = quarantine(ranged, F.coalesce(F.col("start_frame") < F.col("end_frame"), F.lit(False)))
    return good, broken.select("video_id", "path", "error").unionByName(bad.select("video_id", "path", F.lit("the range doesn't run forward").alias("error")))


def build_dataset(videos: DataFrame, annotations: DataFrame, generate: Callable[..., Column], folder: str, seed: int = 42, see: int = 0) -> Build:
    """The whole build: clips, four degraded variants of each, annotated, validated and split by source video.

    ``videos`` are rows of frames (``videos.read_frames`` or ``samples.decode_videos``).  Each stage is written once to ``folder`` and read by all
    that needs it: frames as decoded, the frames of each variant, annotated rows, samples by split.  So codec and
    model run once a row, whatever is asked of the result, and a build that broke off goes on with the stage it was in.
    Only the first two stages have pixels, and none of them is in a shuffle, but for the ``see`` evenly spread frames of each variant that the model is given with
    its prompts, if any.
    """
    stages = Stages(videos.sparkSession, folder)
    decoded = stages.put("decoded", lambda: videos)
    clips, bad = collect_clips(decoded, annotations)
    shape = ("video_id", "path", "frame_idx", "given", "height", "width", "channels", "px")
    frames = stages.put("frames", lambda: V.degrade(fan_out(decoded.where("error IS NULL").select(*shape))).select(*shape, "difficulty_level"))
    lost = frames.where("px IS NULL").select("path", "difficulty_level").distinct()

    def annotated() -> DataFrame:
        text = fan_out(clips).join(lost, ["path", "difficulty_level"], "left_anti")
        if see:
            text = text.join(shown(frames, see), ["path", "difficulty_level"], "left")
        made = annotate(text, generate, "frames" if see else None).drop("frames")
        made = made.withColumns({"gt_interval": F.struct("start_sec", "end_sec"), "prompt": F.lit(P.PROMPT)})
        return made.withColumn("error", F.coalesce("error", F.when(~valid_sample(), "the sample isn't valid")))

    made = stages.put("annotated", annotated)
    samples = stages.put("samples", lambda: split_dataset(made.where("error IS NULL").drop("error"), seed), ("split",))
    level = F.lit(None).cast("double").alias("difficulty_level")
    failures = bad.select("video_id", "path", level, "error").unionByName(made.where("error IS NOT NULL").select("video_id", "path", "difficulty_level", "error"))
    torn = lost.join(clips.select("path", "video_id"), "path").select("video_id", "path", "difficulty_level", F.lit("a frame can't be degraded").alias("error"))
    return Build(samples, failures.unionByName(torn), frames)


def shown(frames: DataFrame, n: int) -> DataFrame:
    """``path``, ``difficulty_level`` and ``frames``, the pixels of ``n`` evenly spread frames of each variant in their order."""
    at = F.lit(0) if n == 1 else F.explode(F.array_distinct(V.frame_indices(F.col("given"), n)))
    chosen = frames.select("path", "difficulty_level", "frame_idx", "px", at.alias("at")).where("frame_idx = at")
    held = chosen.groupBy("path", "difficulty_level").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "px"))).alias("f"))  # n frames
    return held.select("path", "difficulty_level", F.col("f.px").alias("frames"))


def load_built(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Samples of one split of a build; the files of others aren't opened."""
    if split not in SPLITS:
        raise ValueError(f"no split {split!r}; there are {SPLITS}")
    return spark.read.parquet(f"{folder.rstrip('/')}/samples").where(F.col("split") == split)


def with_pixels(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Samples with ``frames``, all those of their variant in order, ready to be sampled or made tensors of.  The one join that moves pixels."""
    held = frames.join(samples.select("path", "difficulty_level"), ["path", "difficulty_level"], "left_semi").groupBy("path", "difficulty_level")
    return samples.join(held.agg(F.sort_array(F.collect_list(F.struct("frame_idx", "px"))).alias("f")).select("path", "difficulty_level", F.col("f.px").alias("frames")), ["path", "difficulty_level"])
