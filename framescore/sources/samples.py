"""Sources and sinks of annotated samples: JSON lines, split maps, clip annotations, videos, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("sft_train", "rl_train", "val", "test")
TEXTS = ("type_annotation", "influence_annotation", "reasoning_annotation", "conclusion_annotation", "answer_annotation")
#: Intervals are two-element arrays on disk, and profiles arrays of [name, severity].
ON_DISK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("video_id", "prompt", *TEXTS, "split")]
    + [T.StructField("difficulty_level", T.DoubleType()), T.StructField("gt_interval", T.ArrayType(T.DoubleType())), T.StructField("degradation_profile", T.ArrayType(T.ArrayType(T.StringType())))]
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are skipped, a malformed one fails, a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], ON_DISK)
    return spark.read.schema(ON_DISK).option("mode", "FAILFAST").json(path)


def read_map(spark: SparkSession, path: str, value: str = "string", key: str = "video_id", name: str = "assigned") -> DataFrame:
    """One JSON object as rows (key, value); a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, {name} {value}")
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, name))


def with_split(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds ``assigned_split``: the map's, or the sample's own where the map has no such id."""
    found = splits.select("video_id", F.col("assigned"), F.lit(True).alias("mapped"))
    return samples.join(found, "video_id", "left").withColumn("assigned_split", F.when(F.col("mapped"), F.col("assigned")).otherwise(F.col("split"))).drop("assigned", "mapped")


def with_defaults(samples: DataFrame) -> DataFrame:
    """Columns of a sample with the defaults of missing ones."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("video_id", "prompt", *TEXTS)]
    ends = F.coalesce("gt_interval", F.array(F.lit(0.0), F.lit(1.0)))
    profile = F.coalesce(F.transform("degradation_profile", lambda x: F.struct(x[0].alias("name"), x[1].try_cast("double").alias("severity"))), F.array().cast("array<struct<name:string,severity:double>>"))
    return samples.select(*text, profile.alias("degradation_profile"), F.coalesce("difficulty_level", F.lit(0.0)).alias("difficulty_level"), F.struct(F.get(ends, 0).alias("start_sec"), F.get(ends, 1).alias("end_sec")).alias("gt_interval"), F.col("split"))


def load_samples(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Samples of one split; what they show as ``split`` is their own, or the one asked for."""
    if split not in SPLITS:
        raise ValueError(f"no split {split!r}; there are {SPLITS}")
    placed = with_split(read_annotations(spark, f"{folder}/annotations.jsonl"), read_map(spark, f"{folder}/splits.json"))
    found = with_defaults(placed.where(F.col("assigned_split") == split))
    return found.withColumn("split", F.coalesce("split", F.lit(split)))


def list_videos(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``video_id``, ``path`` and ``length`` of the .mp4 files right in some folders, by path; their bytes aren't read."""
    return _video_files(spark, folders).select("video_id", "path", "length").orderBy("path")


def video_bytes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``video_id``, ``path`` and ``content`` of the same files, in no order: for stores that only Spark reads, and codecs that take whole files."""
    return _video_files(spark, folders).select("video_id", "path", "content")


def _video_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(folders)
    return files.withColumn("video_id", F.regexp_extract("path", r"([^/]+)\.mp4$", 1))


def read_clip_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Frame and second ranges of clips by ``video_id``, from one JSON object; what an entry lacks is null, a missing file has none."""
    found = read_map(spark, path, "struct<start_frame:int,end_frame:int,start_sec:double,end_sec:double>", name="a")
    return found.select("video_id", "a.*")


def decode_videos(videos: DataFrame, decoder: Callable[[bytes], list[bytes]], height: int, width: int, channels: int = 3, least: int = 25) -> DataFrame:
    """Rows of ``videos.FRAME`` of whole files (see ``video_bytes``) by a given codec, a video at a time; an ``error`` instead where one can't be read or is too short."""
    from .videos import _TYPES, BATCH_BYTES, FRAME, _batch

    def rows(name: str, path: str, content: bytes) -> list[tuple]:
        try:
            frames = decoder(content)
            if len(frames) < least:
                raise ValueError(f"{len(frames)} frames, {least} are needed")
        except Exception as e:  # whatever a codec raises; a row's failure is data here, not the job's
            return [(name, path, -1, *[None] * (len(_TYPES) - 4), str(e) or type(e).__name__)]
        return [(name, path, i, len(frames), i, len(frames), height, width, channels, px, None) for i, px in enumerate(frames)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made = rows(*(b.column(c)[i].as_py() for c in ("video_id", "path", "content")))
                step = max(1, BATCH_BYTES // (len(made[0][-2] or b"") + 1))
                for j in range(0, len(made), step):
                    yield _batch(made[j : j + step])

    return videos.select("video_id", "path", "content").mapInArrow(run, FRAME)


def with_frames(samples: DataFrame, frames: DataFrame, n: int = 25, size: int = 448) -> DataFrame:
    """Samples with their ``frames`` (of rows (video_id, frames), one a video); black ones where there is no video."""
    black = F.array_repeat(F.unhex(F.repeat(F.lit("00"), size * size * 3)), n)
    return samples.join(frames.select("video_id", "frames"), "video_id", "left").withColumn("frames", F.coalesce("frames", black))


def batches(rows: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """Adds ``batch``: rows in an order drawn by ``seed``, ``size`` of them in each.

    Rows are numbered within hash buckets whose counts are summed, so no single task orders all.
    """
    from pyspark.sql import Window

    mixed = rows.withColumn("drawn", F.xxhash64(F.lit(seed), key)).withColumn("part", F.shiftright("drawn", 56))
    counts = mixed.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 256 rows
    at = F.row_number().over(Window.partitionBy("part").orderBy("drawn", key)) - 1
    return mixed.withColumn("at", at).join(F.broadcast(before), "part").withColumn("batch", F.floor((F.col("at") + F.col("before")) / size)).drop("drawn", "part", "at", "before")


def write_results(rows: DataFrame, folder: str) -> None:
    """Results as JSON lines, nulls written out."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def result_rows(rows: DataFrame) -> DataFrame:
    """``raw_output`` and ``parsed`` (null if it can't be) with the interval of the answer."""
    from ..functions.parsing import interval, parse_response

    b = parse_response(F.col("prediction"))
    held = rows.withColumn("b", b)
    span = interval(F.col("b.answer_block"))
    pair = F.when(span.isNotNull(), F.array(span["start_sec"], span["end_sec"]))
    parsed = F.struct(*(F.col(f"b.{c}").alias(c.removesuffix("_block")) for c in ("type_block", "influence_block", "reasoning_block", "conclusion_block", "answer_block")), pair.alias("interval"))
    return held.select(*rows.columns, F.col("prediction").alias("raw_output"), F.when(F.col("b").isNotNull(), parsed).alias("parsed"))


def load_config(text: str, section: str, allowed: dict) -> dict:
    """Values of one section of a YAML text; keys that aren't known are left out."""
    import yaml

    found = (yaml.safe_load(text) or {}).get(section) or {}
    return {**allowed, **{k: v for k, v in found.items() if k in allowed}}
