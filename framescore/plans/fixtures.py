"""Inputs of the queries, derived from the supplied tables by expressions that Spark and DuckDB share.

Times are whole tenths of a second, written out by integer arithmetic, so no number is formatted as
a fraction.  Each fixture is a list of steps; a step adds columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _tenths(x: str) -> str:
    return f"concat(CAST(CAST(floor(({x}) / 10) AS BIGINT) AS STRING), '.', CAST(({x}) % 10 AS STRING))"


RESPONSES = [
    {"e": "event_id", "gs": "(event_id % 40) * 5", "ge": "(event_id % 40) * 5 + 10 + (event_id % 7) * 10"},
    {"ps": "greatest(0, gs + (3 * e) % 50 - 20)"},
    {"pe": "ps + 10 + (e % 5) * 10"},
    {"a": _tenths("ps"), "b": _tenths("pe")},
    {
        "answer": "CASE e % 5 WHEN 0 THEN concat('Collision [', a, ', ', b, ']') WHEN 1 THEN concat('start_sec: ', a, ', end_sec: ', b) WHEN 2 THEN concat('from ', a, ' to ', b, ' sec') WHEN 3 THEN concat(a, ' - ', b, ' s') ELSE 'no interval' END",
        "kind": "CASE WHEN e % 6 = 0 THEN 'none' ELSE concat('motion_blur:0.', CAST(2 * (1 + e % 4) AS STRING), '; fog:0.4', CASE WHEN e % 10 = 7 THEN '; fog:0.8' ELSE '' END) END",
    },
    {
        "body": "concat('<INFLUENCE>i<INFLUENCE_END><REASONING> step ', CAST(e % 9 AS STRING), '. <REASONING_END><CONCLUSION>c<CONCLUSION_END>')",
        "first": "concat('<TYPE>', CASE WHEN e % 11 = 3 THEN '' ELSE kind END, '<TYPE_END>')",
        "last": "concat('<ANSWER>', answer, '<ANSWER_END>')",
    },
    {"text": "CASE e % 11 WHEN 0 THEN concat(first, body) WHEN 1 THEN concat(last, first, body) WHEN 2 THEN lower(concat(first, body, last)) ELSE concat(first, body, last) END"},
]
CLIPS = [
    {"d": "doc_id", "video_id": "concat('vid_', CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING), '_diff', CAST(doc_id % 4 AS STRING))", "n_frames": "25 + n_chars % 400"},
    {"level": "CASE WHEN d % 17 = 2 THEN CAST(0.5 AS DOUBLE) WHEN d % 4 = 0 THEN CAST(0.0 AS DOUBLE) WHEN d % 4 = 1 THEN CAST(0.2 AS DOUBLE) WHEN d % 4 = 2 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END", "ss": "n_chars % 50"},
    {"se": "CASE WHEN d % 17 = 1 THEN ss - 5 ELSE ss + 10 + (d % 9) * 10 END", "note": "CASE WHEN d % 17 = 0 THEN '  ' ELSE concat('note ', CAST(d % 5 AS STRING)) END"},
]


def steps(rows: DataFrame, fixture: list[dict[str, str]]) -> DataFrame:
    for step in fixture:
        rows = rows.selectExpr("*", *(f"{v} AS {k}" for k, v in step.items()))
    return rows


def sql(table: str, fixture: list[dict[str, str]], name: str) -> str:
    """The fixture as common table expressions of DuckDB; the last is ``name``."""
    out, below = [], table
    for i, step in enumerate(fixture):
        this = name if i == len(fixture) - 1 else f"{name}_{i}"
        cols = ", ".join(f"{v} AS {k}" for k, v in step.items()).replace("AS STRING", "AS VARCHAR")
        out.append(f"{this} AS (SELECT *, {cols} FROM {below})")
        below = this
    return ", ".join(out)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, a few tasks a core.  A file of one number a row is small and read by few tasks, while what
    a query makes of a row takes far longer than to send it."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")), RESPONSES)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), CLIPS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the next one.  Conversations are dealt out by as many tasks as ``spread`` has, for the same reason."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    c = c.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "conv_id")
    c = c.select("conv_id", "turn", F.col("text").alias("hyp"), F.lead("text").over(by).alias("ref"))
    return c.where("ref IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "hyp", "ref")


RESPONSES_SQL = sql("(SELECT event_id FROM events)", RESPONSES, "responses")
CLIPS_SQL = sql("(SELECT doc_id, n_chars FROM documents)", CLIPS, "clips")
PAIRS_SQL = "pairs AS (SELECT conv_id * 1000 + turn AS id, hyp, ref FROM (SELECT conv_id, turn, text AS hyp, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations) WHERE ref IS NOT NULL)"
#: Frames 8 pixels wide from the components of a vector, as many rows as they fill.
PIXELS_SQL = "pixels AS (SELECT vec_id, list_transform(list_slice(embedding, 1, len(embedding) - len(embedding) % 8), lambda x: CAST(least(255, floor(abs(CAST(x AS DOUBLE)) * 255)) AS INT)) AS px, [0.2, 0.4, 0.8][vec_id % 3 + 1]::DOUBLE AS s FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.slice("embedding", F.lit(1), F.size("embedding") - F.size("embedding") % 8)
    px = F.transform(whole, lambda x: F.least(F.lit(255), F.floor(F.abs(x.cast("double")) * 255)).cast("int"))
    s = F.element_at(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.8)), (F.col("vec_id") % 3 + 1).cast("int"))
    return spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("vec_id", px.alias("px"), s.alias("s"))


def binary(px: Column) -> Column:
    """Pixels as bytes."""
    return F.unhex(F.array_join(F.transform(px, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


#: A video a vector, two to a base id: frame k has all pixels 3 k higher, around 256.  Some are short, of some the last frame breaks off.
VIDEOS = [
    {"video_id": "concat('vid_', CAST(CAST(floor(vec_id / 2) AS BIGINT) AS STRING), '_diff', CAST(vec_id % 2 AS STRING))", "n": "CASE WHEN vec_id % 13 = 5 THEN 10 ELSE 25 + vec_id % 7 END"},
    {"flaw": "CASE WHEN vec_id % 13 = 5 THEN '10 frames, 25 are needed' WHEN vec_id % 29 = 7 THEN concat('frame ', CAST(n - 1 AS STRING), ' breaks off') END"},
]
#: Ranges of two thirds of the videos; some run backward in frames, some in seconds.
RANGES = [{"start_frame": "3", "end_frame": "CASE WHEN d % 17 = 4 THEN 2 ELSE 20 END", "start_sec": "CAST(ss AS DOUBLE) / 10", "end_sec": "CAST(se AS DOUBLE) / 10"}]


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(pixels(spark, sf_dir).select("vec_id", "px"), VIDEOS)


def video_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of its own with the videos as files."""
    from ..sources.stages import new_folder
    from ..sources.videos import write_clips

    frames = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda k: binary(F.transform("px", lambda x: (x + 3 * k) % 256)))
    cut = F.when(F.col("flaw").startswith("frame"), F.transform("f", lambda b, k: F.when(k == F.col("n") - 1, F.substring(b, F.lit(1), F.lit(3))).otherwise(b))).otherwise(F.col("f"))
    rows = videos(spark, sf_dir).withColumn("f", frames)
    folder = new_folder(spark, "videos")
    write_clips(rows.select("video_id", cut.alias("frames"), F.floor(F.size("px") / 8).cast("int").alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels")), folder)
    return folder


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = steps(clips(spark, sf_dir).where("d % 3 != 0").withColumnRenamed("d", "vec_id").drop("video_id", "n"), [{"video_id": VIDEOS[0]["video_id"], "d": "vec_id"}, *RANGES])
    return c.select("video_id", F.col("start_frame").cast("int"), F.col("end_frame").cast("int"), "start_sec", "end_sec")


VIDEOS_SQL = f"{PIXELS_SQL}, {sql('pixels', VIDEOS, 'videos')}, " + sql("(SELECT * FROM clips WHERE d % 3 <> 0)", RANGES, "ranges")
