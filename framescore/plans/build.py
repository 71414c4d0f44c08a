"""Queries over clips and frames: dataset building, splits, degradation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing as P
from ..operators import dataset as D
from ..operators import frames as V
from ..sources import samples as R
from ..sources import videos as S
from ..sources.stages import Stages, new_folder
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


_CLIPS = f"WITH {X.CLIPS_SQL}"
_LEVELS = "(VALUES (0.0::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE), (0.8::DOUBLE)) AS l(difficulty_level)"
_TEXT = "CASE WHEN difficulty_level = 0 THEN 'none' ELSE 'motion_blur:' || printf('%.1f', difficulty_level) || '; low_light:' || printf('%.1f', difficulty_level) END"
_PHRASE = "CASE WHEN difficulty_level = 0 THEN 'none' ELSE 'motion_blur (severity=' || printf('%.1f', difficulty_level) || '), low_light (severity=' || printf('%.1f', difficulty_level) || ')' END"
_HOW = "CASE WHEN difficulty_level >= 0.6 THEN 'detailed' WHEN difficulty_level >= 0.3 THEN 'moderate' ELSE 'concise' END"


def _fanned(spark, sf_dir):
    return D.fan_out(X.clips(spark, sf_dir).select("d", "video_id", "note"))


@query("profile_fanout", f"{_CLIPS} SELECT d, difficulty_level, {_TEXT} AS profile FROM clips, {_LEVELS}")
def profile_fanout(spark, sf_dir):
    return _fanned(spark, sf_dir).select("d", "difficulty_level", P.profile_text(F.col("degradation_profile")).alias("profile"))


@query("mean_severity", f"{_CLIPS} SELECT d, difficulty_level, round(difficulty_level, 6) AS severity FROM clips, {_LEVELS}")
def mean_severity(spark, sf_dir):
    return _fanned(spark, sf_dir).select("d", "difficulty_level", F.round(P.mean_severity(F.col("degradation_profile")), 6).alias("severity"))


@query("compactness_case", f"{_CLIPS} SELECT {_HOW} AS kind, count(*) AS n FROM clips, {_LEVELS} GROUP BY 1")
def compactness_case(spark, sf_dir):
    s = P.mean_severity(F.col("degradation_profile"))
    return _fanned(spark, sf_dir).groupBy(P.compactness_case(s).alias("kind")).agg(F.count("*").alias("n"))


_INFLUENCE = f"'These factors make a traffic clip hard to observe: ' || {_PHRASE} || '. Say briefly how they weaken the visual evidence and which other cues can stand in.'"
_REASON = f"'A traffic clip is hard to observe because of: ' || {_PHRASE} || '. Effect on the evidence: ' || note || '. Reason step by step from cause to effect, in keeping with both.'"
_REWRITE = "'Rewrite this reasoning ' || CASE WHEN difficulty_level >= 0.6 THEN 'in more detail, with steps that make up for weak evidence' WHEN difficulty_level >= 0.3 THEN 'in moderate detail, with every causal step' ELSE 'concisely, with the essential causal steps only' END || ':' || chr(10) || note"


@query("prompts", f"{_CLIPS} SELECT d, difficulty_level, {_INFLUENCE} AS influence, {_REASON} AS reasoning, 'State in one short judgment what event this reasoning shows:' || chr(10) || note AS conclusion, 'Give the anomaly''s type, its interval as [start_sec, end_sec] and a brief cause.' || chr(10) || 'Conclusion: ' || note AS answer, {_REWRITE} AS compactness FROM clips, {_LEVELS}")
def prompts(spark, sf_dir):
    p, n = F.col("degradation_profile"), F.col("note")
    return _fanned(spark, sf_dir).select("d", "difficulty_level", P.influence_prompt(p).alias("influence"), P.reasoning_prompt(p, n).alias("reasoning"), P.conclusion_prompt(n).alias("conclusion"), P.answer_prompt(n).alias("answer"), P.compactness_prompt(n, P.mean_severity(p)).alias("compactness"))


@query("annotate_chain", f"{_CLIPS} SELECT d, difficulty_level, length('Give the anomaly''s type, its interval as [start_sec, end_sec] and a brief cause.' || chr(10) || 'Conclusion: ') + 5 AS answer_length, {_TEXT} AS type_annotation FROM clips, {_LEVELS}")
def annotate_chain(spark, sf_dir):
    # a stand-in for a model: its answer is how long the prompt is, to five places
    made = D.annotate(_fanned(spark, sf_dir), lambda prompt: F.lpad(F.length(prompt).cast("string"), 5, "0"))
    return made.select("d", "difficulty_level", F.col("answer_annotation").cast("long").alias("answer_length"), "type_annotation")


@query("target_serialize", f"{_CLIPS} SELECT d, '<TYPE>none<TYPE_END><INFLUENCE>' || note || '<INFLUENCE_END><REASONING>r<REASONING_END><CONCLUSION>c<CONCLUSION_END><ANSWER>' || video_id || '<ANSWER_END>' AS target FROM clips")
def target_serialize(spark, sf_dir):
    blocks = (F.lit("none"), F.col("note"), F.lit("r"), F.lit("c"), F.col("video_id"))
    return X.clips(spark, sf_dir).select("d", P.serialize_target(*blocks).alias("target"))


def _samples(spark, sf_dir):
    c = X.clips(spark, sf_dir)
    span = F.struct((F.col("ss") / 10.0).alias("start_sec"), (F.col("se") / 10.0).alias("end_sec"))
    texts = [(F.col("note") if t == "influence_annotation" else F.lit("x")).alias(t) for t in R.TEXTS]
    return c.select("d", "video_id", F.col("level").alias("difficulty_level"), span.alias("gt_interval"), *texts)


_VALID = "level IN (0.0, 0.2, 0.4, 0.8) AND ss < se AND trim(note) <> ''"


@query("validate_samples", f"{_CLIPS} SELECT d, {_VALID} AS valid FROM clips")
def validate_samples(spark, sf_dir):
    return _samples(spark, sf_dir).select("d", D.valid_sample().alias("valid"))


@query("quarantine_counts", f"{_CLIPS} SELECT level AS difficulty_level, count(*) FILTER (WHERE {_VALID}) AS good, count(*) FILTER (WHERE NOT ({_VALID})) AS bad FROM clips GROUP BY level")
def quarantine_counts(spark, sf_dir):
    good, bad = D.quarantine(_samples(spark, sf_dir), D.valid_sample())
    both = good.withColumn("good", F.lit(1)).unionByName(bad.withColumn("good", F.lit(0)))
    return both.groupBy("difficulty_level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))


_BASE = "SELECT DISTINCT split_part(video_id, '_diff', 1) AS base FROM "
_SPLIT = (
    "r AS (SELECT base, row_number() OVER (ORDER BY md5('42:' || base), base) AS k, count(*) OVER () AS n FROM ({base})), "
    "p AS (SELECT base, CASE WHEN k <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r), "
    "q AS (SELECT base, row_number() OVER (ORDER BY md5('42:sft:' || base), base) AS k, count(*) OVER () AS n FROM p WHERE split = 'train'), "
    "s AS (SELECT base, CASE WHEN k <= floor(n * 0.30::DOUBLE) THEN 'sft_train' ELSE 'rl_train' END AS split FROM q UNION ALL SELECT base, split FROM p WHERE split <> 'train')"
)
_SPLITS = _SPLIT.format(base=_BASE + "clips")


@query("split_assign", f"{_CLIPS}, {_SPLITS} SELECT d, split FROM clips JOIN s ON split_part(video_id, '_diff', 1) = base")
def split_assign(spark, sf_dir):
    return D.split_dataset(X.clips(spark, sf_dir).select("d", "video_id")).select("d", "split")


@query("split_counts", f"{_CLIPS}, {_SPLITS} SELECT split, count(*) AS samples, count(DISTINCT base) AS videos FROM clips JOIN s ON split_part(video_id, '_diff', 1) = base GROUP BY split")
def split_counts(spark, sf_dir):
    s = D.split_dataset(X.clips(spark, sf_dir).select("d", "video_id"))
    return s.groupBy("split").agg(F.count("*").alias("samples"), F.count_distinct(P.base_id(F.col("video_id"))).alias("videos"))


@query("load_with_split_map", f"{_CLIPS} SELECT d, CASE WHEN d % 3 <> 0 THEN CASE WHEN d % 5 = 0 THEN 'val' ELSE 'rl_train' END ELSE 'test' END AS assigned_split FROM clips")
def load_with_split_map(spark, sf_dir):
    c = X.clips(spark, sf_dir).select("d", "video_id", F.lit("test").alias("split"))
    named = c.where("d % 3 != 0").select("video_id", F.when(F.col("d") % 5 == 0, "val").otherwise("rl_train").alias("assigned"))
    return R.with_split(c, named).select("d", "assigned_split")


@query("clip_defaults", f"{_CLIPS} SELECT d, CASE WHEN d % 2 = 0 THEN 3 ELSE 0 END AS start_frame, CASE WHEN d % 2 = 0 THEN 20 ELSE n_frames - 1 END AS end_frame, round(CASE WHEN d % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0 END, 6) AS start_sec, round(CASE WHEN d % 2 = 0 THEN 1.5::DOUBLE ELSE n_frames / 30.0::DOUBLE END, 6) AS end_sec FROM clips")
def clip_defaults(spark, sf_dir):
    c = X.clips(spark, sf_dir).select("d", "video_id", "n_frames")
    known = c.where("d % 2 = 0").select("video_id", F.lit(3).alias("start_frame"), F.lit(20).alias("end_frame"), F.lit(0.5).alias("start_sec"), F.lit(1.5).alias("end_sec"))
    r = D.clip_defaults(c, known)
    return r.select("d", "start_frame", F.col("end_frame").cast("long").alias("end_frame"), F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


@query("sample_defaults", f"{_CLIPS} SELECT d, CASE WHEN d % 2 = 0 THEN '' ELSE note END AS reasoning_annotation, CASE WHEN d % 3 = 0 THEN 1.0 ELSE ss / 10.0::DOUBLE + 1 END AS end_sec, CASE WHEN d % 4 = 0 THEN 0 ELSE 1 END AS factors FROM clips")
def sample_defaults(spark, sf_dir):
    c = X.clips(spark, sf_dir)
    texts = [F.when(F.col("d") % 2 == 1, F.col("note")).alias(t) for t in R.TEXTS]
    span = F.when(F.col("d") % 3 != 0, F.array(F.lit(0.0), F.col("ss") / 10.0 + 1))
    profile = F.when(F.col("d") % 4 != 0, F.array(F.array(F.lit("fog"), F.lit("0.4"))))
    raw = c.select("d", "video_id", F.lit(None).cast("string").alias("prompt"), *texts, F.lit(None).cast("double").alias("difficulty_level"), span.alias("gt_interval"), profile.alias("degradation_profile"), F.col("d").cast("string").alias("split"))
    return R.with_defaults(raw).select(F.col("split").cast("long").alias("d"), "reasoning_annotation", "gt_interval.end_sec", F.size("degradation_profile").alias("factors"))


_FAMILY = "(VALUES ('motion_blur', 'blur'), ('lens_flare', 'blur'), ('sensor_noise', 'blur'), ('low_light', 'environment'), ('rain_snow', 'environment'), ('fog', 'environment'), ('tunnel_low_light', 'environment'), ('vehicle_mask', 'occlusion'), ('interaction_area_mask', 'occlusion')) AS f(name, family)"


@query("factor_counts", f"WITH {X.RESPONSES_SQL}, e AS (SELECT unnest(string_split(kind, ';')) AS entry FROM responses WHERE kind <> 'none'), n AS (SELECT trim(string_split(entry, ':')[1]) AS name, CAST(string_split(entry, ':')[2] AS DOUBLE) AS severity FROM e) SELECT family, count(*) AS n, round(avg(severity), 6) AS severity FROM n JOIN {_FAMILY} USING (name) GROUP BY family")
def factor_counts(spark, sf_dir):
    """Factors of predicted profiles by family."""
    entries = X.responses(spark, sf_dir).select(F.explode(P.parse_profile(F.col("kind"))).alias("e")).select("e.name", "e.severity")
    return entries.join(F.broadcast(D.factor_dim(spark)), "name").groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("severity"), 6).alias("severity"))  # nine rows


@query("batch_sizes", f"{_CLIPS}, b AS (SELECT unnest(range(0, CAST(ceil(count(*) / 16) AS BIGINT))) AS batch, count(*) AS n FROM clips) SELECT batch, least(16, n - 16 * batch) AS size FROM b")
def batch_sizes(spark, sf_dir):
    return R.batches(X.clips(spark, sf_dir).select("d"), 16, "d").groupBy("batch").agg(F.count("*").alias("size"))


@query("group_members", f"{_CLIPS} SELECT d % 50 AS k, count(*) AS responses FROM clips, (VALUES (1), (2), (3), (4)) AS m(member) GROUP BY d % 50")
def group_members(spark, sf_dir):
    s = D.sample_group(X.clips(spark, sf_dir).select("d", F.col("note").alias("prompt")), F.upper)
    return s.groupBy((F.col("d") % 50).alias("k")).agg(F.count("*").alias("responses"))


# --- frames ---


@query("frame_indices", f"{_CLIPS} SELECT d, list_transform(range(0, 25), lambda i: CAST(i * (n_frames - 1) // 24 AS INT)) AS l FROM clips".replace(" AS l FROM clips", " AS l FROM clips)").replace("SELECT d, list", ", f AS (SELECT d, list") + " SELECT d, list_sum(l) AS total, l[2] AS second, l[25] AS last FROM f")
def frame_indices(spark, sf_dir):
    f = X.clips(spark, sf_dir).select("d", V.frame_indices(F.col("n_frames")).alias("l"))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x)
    return f.select("d", total.alias("total"), F.get("l", 1).alias("second"), F.get("l", 24).alias("last"))


def _summed(rows, px):
    """A frame as two sums, one of them by place."""
    held = rows.withColumn("q", px)
    plain = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    placed = F.aggregate(F.transform("q", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return held.select("vec_id", plain.alias("total"), placed.alias("weighted"))


_SUMS = "SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_sum(list_transform(q, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS weighted FROM f"


def _summed_sql(expr: str) -> str:
    return f"WITH {X.PIXELS_SQL}, f AS (SELECT vec_id, {expr} AS q FROM pixels) {_SUMS}"


@query("low_light", _summed_sql("list_transform(px, lambda x: CAST(floor(x * (1.0::DOUBLE - s * 0.8::DOUBLE)) AS INT))"))
def low_light(spark, sf_dir):
    return _summed(X.pixels(spark, sf_dir), V.low_light(F.col("px"), F.col("s")))


@query("fog", _summed_sql("list_transform(px, lambda x: CAST(round_even(x * (1 - s * 0.7::DOUBLE) + s * 0.7::DOUBLE * 220.0::DOUBLE, 0) AS INT))"))
def fog(spark, sf_dir):
    return _summed(X.pixels(spark, sf_dir), V.fog(F.col("px"), F.col("s")))


_H, _W = "CAST(floor((len(px) // 8) * s * 0.5::DOUBLE) AS INT)", "CAST(floor(8 * s * 0.5::DOUBLE) AS INT)"


def _box_sql(corner: bool) -> str:
    top, left = ("0", "0") if corner else (f"(len(px) // 8 - {_H}) // 2", f"(8 - {_W}) // 2")
    inside = f"(i - 1) // 8 >= {top} AND (i - 1) // 8 < {top} + {_H} AND (i - 1) % 8 >= {left} AND (i - 1) % 8 < {left} + {_W}"
    return f"list_transform(px, lambda x, i: CASE WHEN {_H} >= 1 AND {_W} >= 1 AND {inside} THEN 0 ELSE x END)"


@query("occlusion_centre", _summed_sql(_box_sql(False)))
def occlusion_centre(spark, sf_dir):
    return _summed(X.pixels(spark, sf_dir), V.occlusion(F.col("px"), F.col("s"), F.floor(F.size("px") / 8).cast("int"), 8))


@query("occlusion_corner", _summed_sql(_box_sql(True)))
def occlusion_corner(spark, sf_dir):
    return _summed(X.pixels(spark, sf_dir), V.occlusion(F.col("px"), F.col("s"), F.floor(F.size("px") / 8).cast("int"), 8, True))


#: ``{k}`` places around each pixel of a row of eight, mirrored at both ends as often as need be.
_MIRROR = "(CASE WHEN (((i - 1) % 8 + d) % 14 + 14) % 14 < 8 THEN (((i - 1) % 8 + d) % 14 + 14) % 14 ELSE 14 - (((i - 1) % 8 + d) % 14 + 14) % 14 END)"


def _blur_sql(k: str) -> str:
    return f"list_transform(px, lambda x, i: CAST(round_even(list_sum(list_transform(range(-({k} // 2), {k} // 2 + 1), lambda d: px[(i - 1) // 8 * 8 + {_MIRROR} + 1])) / {k}::DOUBLE, 0) AS INT))"


@query("motion_blur", _summed_sql(_blur_sql("7")))
def motion_blur(spark, sf_dir):
    return _summed(X.pixels(spark, sf_dir), V.motion_blur(F.col("px"), 0.2, 8, 8))


def _degraded(spark, sf_dir, *names: str):
    p = X.pixels(spark, sf_dir)
    height = F.floor(F.size("px") / 8).cast("int")
    one = F.array(*(F.struct(F.lit(name).alias("name"), F.col("s").alias("severity")) for name in names))
    rows = p.select(F.col("vec_id").cast("string").alias("video_id"), F.lit(0).alias("frame_idx"), height.alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), X.binary(F.col("px")).alias("px"), one.alias("degradation_profile"))
    return V.degrade(rows).select(F.col("video_id").cast("long").alias("vec_id"), F.sha2("px", 256).alias("px_sha256"), F.length("px").alias("n"))


def _mixed_sql(x: str) -> str:
    """The mixture of ``operators/frames.py`` in SQL; lists of one hold what is used twice."""
    a = f"list_transform([{x}], lambda v: (xor(v, v >> 16) * 739982445) & 4294967295)"
    b = f"list_transform({a}, lambda v: (xor(v, v >> 12) * 695872825) & 4294967295)"
    return f"list_transform({b}, lambda v: xor(v, v >> 15))[1]"


def _uniform_sql(n: str) -> str:
    inner = _mixed_sql(f"(key + ({n}) * 2654435769) & 4294967295")
    return f"(({_mixed_sql(f'xor({inner}, key)')}) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


#: Pixels with the key of their frame, of which the factor is the first.
_KEYED = f"{X.PIXELS_SQL}, seeded AS (SELECT *, CAST(('0x' || substr(md5(vec_id || ':0'), 1, 8)) AS BIGINT) AS seed FROM pixels), keyed AS (SELECT vec_id, px, s, len(px) // 8 AS h, {_mixed_sql('seed')} AS key FROM seeded)"
_HASHED = "sha256(unhex(array_to_string(list_transform(q, lambda x: printf('%02X', x)), ''))) AS px_sha256, CAST(len(q) AS INT) AS n"
_NOISY = f"list_transform(px, lambda x, i: CAST(trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, x + s * 50.0::DOUBLE * sqrt(-2.0::DOUBLE * ln({_uniform_sql('2 * (i - 1)')})) * cos(2 * pi() * {_uniform_sql('2 * (i - 1) + 1')})))) AS INT))"
_AWAY = "((i - 1) // 8 - CAST(floor(h * 0.3::DOUBLE) AS BIGINT)) * ((i - 1) // 8 - CAST(floor(h * 0.3::DOUBLE) AS BIGINT)) + ((i - 1) % 8 - 5) * ((i - 1) % 8 - 5)"
_RADIUS = f"(reach - (reach - greatest(CAST(ceil(sqrt({_AWAY})) AS BIGINT), 1 + (reach - 1) % ring)) // ring * ring)"
_FLARED = f"CASE WHEN reach < 1 THEN px ELSE list_transform(px, lambda x, i: CASE WHEN {_AWAY} <= reach * reach THEN CAST(trunc(s * 200 * (1 - {_RADIUS}::DOUBLE / reach)) AS INT) ELSE x END) END"
_DROP = lambda k, m, c: f"CAST(floor({_uniform_sql(f'5 * j + {k}')} * {m} + {c}) AS BIGINT)"
_RAINED = f"""WITH {_KEYED}, j AS (SELECT *, unnest(range(0, CAST(floor(s * 300) AS BIGINT))) AS j FROM keyed),
d AS (SELECT vec_id, j, h, {_DROP(0, 'h', 0)} AS y, {_DROP(1, 8, 0)} AS x, {_DROP(2, 15, 5)} AS n, ({_uniform_sql('5 * j + 3')} * 40 - 20) * (pi() / 180) AS lean, {_DROP(4, 75, 180)} AS light FROM j),
e AS (SELECT *, CAST(floor(n * cos(lean) + 0.5::DOUBLE) AS BIGINT) AS dy, CAST(floor(n * sin(lean) + 0.5::DOUBLE) AS BIGINT) AS dx FROM d),
t AS (SELECT *, unnest(range(0, dy + 1)) AS t FROM e),
p AS (SELECT vec_id, j, light, y + t AS y, x + CASE WHEN dx < 0 THEN -1 ELSE 1 END * ((2 * abs(dx) * t + dy) // (2 * dy)) AS x, h FROM t),
l AS (SELECT vec_id, 8 * y + x AS i, arg_max(light, j) AS light FROM p WHERE y < h AND x BETWEEN 0 AND 7 GROUP BY vec_id, y, x),
m AS (SELECT vec_id, list(i) AS spots, list(light) AS lights FROM l GROUP BY vec_id),
q AS (SELECT k.vec_id, list_transform(px, lambda x, i: coalesce(lights[list_position(spots, i - 1)], x)) AS q FROM keyed k LEFT JOIN m USING (vec_id)) SELECT vec_id, {_HASHED} FROM q"""


@query("sensor_noise", f"WITH {_KEYED}, q AS (SELECT vec_id, {_NOISY} AS q FROM keyed) SELECT vec_id, {_HASHED} FROM q")
def sensor_noise(spark, sf_dir):
    return _degraded(spark, sf_dir, "sensor_noise")


@query("rain_snow", _RAINED)
def rain_snow(spark, sf_dir):
    return _degraded(spark, sf_dir, "rain_snow")


@query("lens_flare", f"WITH {_KEYED}, f AS (SELECT *, CAST(floor(least(h, 8) * s * 0.4::DOUBLE) AS BIGINT) AS reach FROM keyed), g AS (SELECT *, greatest(1, reach // 5) AS ring FROM f), q AS (SELECT vec_id, {_FLARED} AS q FROM g) SELECT vec_id, {_HASHED} FROM q")
def lens_flare(spark, sf_dir):
    return _degraded(spark, sf_dir, "lens_flare")


@query("sensor_noise_column", f"WITH {_KEYED}, f AS (SELECT vec_id, {_NOISY} AS q FROM keyed) {_SUMS}")
def sensor_noise_column(spark, sf_dir):
    """The same numbers as an expression, without Python."""
    key = V.frame_key(F.col("vec_id"), F.lit(0))
    return _summed(X.pixels(spark, sf_dir), V.sensor_noise(F.col("px"), F.col("s"), key))


_CHAIN = "list_transform({px}, lambda x, i: {then})"
_DARKENED = _CHAIN.format(px="px", then="CAST(floor(x * (1.0::DOUBLE - s * 0.8::DOUBLE)) AS INT)")
_FOGGED = _CHAIN.format(px=_DARKENED, then="CAST(round_even(x * (1 - s * 0.7::DOUBLE) + s * 0.7::DOUBLE * 220.0::DOUBLE, 0) AS INT)")


@query("effect_chain", f"WITH {X.PIXELS_SQL}, f AS (SELECT vec_id, s, px AS old, {_FOGGED} AS px FROM pixels), q AS (SELECT vec_id, {_box_sql(False)} AS q FROM f) SELECT vec_id, {_HASHED} FROM q")
def effect_chain(spark, sf_dir):
    """Several factors in their order; one that isn't known changes nothing."""
    return _degraded(spark, sf_dir, "low_light", "unheard_of", "fog", "vehicle_mask")


# --- from files ---

#: The sum of all pixels of each frame of each variant; ``k`` numbers frames.
_VARIANTS = (
    f"raw AS (SELECT vec_id, k, list_transform(px, lambda x: CAST((x + 3 * k) % 256 AS INT)) AS px FROM (SELECT *, unnest(range(0, n)) AS k FROM videos)), "
    f"blurred AS (SELECT vec_id, k, level, {_blur_sql('w')} AS px, level AS s FROM raw, (VALUES (0.2::DOUBLE, 7), (0.4::DOUBLE, 13), (0.8::DOUBLE, 25)) AS v(level, w)), "
    "frames AS (SELECT vec_id, k, level, CAST(list_sum(list_transform(px, lambda x: CAST(floor(x * (1.0::DOUBLE - s * 0.8::DOUBLE)) AS INT))) AS BIGINT) AS px_total FROM blurred "
    "UNION ALL SELECT vec_id, k, 0.0::DOUBLE, CAST(list_sum(px) AS BIGINT) FROM raw)"
)


@F.arrow_udf(T.LongType())
def _byte_sum(px: pa.Array) -> pa.Array:
    """The sum of the bytes of a binary."""
    some = np.flatnonzero(pc.fill_null(pc.binary_length(px), 0).to_numpy())
    total = np.zeros(len(px), np.int64)
    if len(some):  # those without bytes, which have no place of their own in what is joined, stay 0
        held = px.take(pa.array(some)).cast(pa.large_binary())
        ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        total[some] = np.add.reduceat(np.frombuffer(held.buffers()[2], np.uint8)[: ends[-1]], ends[:-1], dtype=np.int64)
    return pa.array(total, mask=px.is_null().to_numpy(zero_copy_only=False))


@query("video_scan", f"""WITH {X.CLIPS_SQL}, {X.VIDEOS_SQL}, i AS (SELECT *, unnest(range(0, 25)) AS i FROM videos WHERE flaw IS NULL), p AS (SELECT *, i * (n - 1) // 24 AS k FROM i)
SELECT video_id, CAST(i AS INT) AS frame_idx, CAST(k AS INT) AS place, CAST(n AS INT) AS n_frames, CAST(list_sum(list_transform(px, lambda x: (x + 3 * k) % 256)) AS BIGINT) AS px_total, NULL::VARCHAR AS error FROM p
UNION ALL SELECT video_id, -1, NULL, NULL, NULL, flaw FROM videos WHERE flaw IS NOT NULL""")
def video_scan(spark, sf_dir):
    """25 evenly spread frames of each file; those of damaged and short files as rows with their error."""
    found = S.read_frames(spark, [X.video_files(spark, sf_dir)], frames=25)
    return found.select("video_id", "frame_idx", "place", "n_frames", _byte_sum(F.col("px")).alias("px_total"), "error")


def _stand_in(prompt: str, frames) -> str:
    """Says how long the prompt is and how bright what it is shown; some sums are too much for it."""
    total = sum(sum(f) for f in frames)
    if total % 11 == 3:
        raise ValueError(f"{total} is too much")
    return f"{len(prompt)} {total}"


_SAID = "length({prompt}) || ' ' || {seen}"
_NOTE = lambda sql, note: sql.replace("note", note)
_BUILD_SQL = f"""WITH {X.CLIPS_SQL}, {X.VIDEOS_SQL}, {_VARIANTS},
c AS (SELECT v.vec_id, v.video_id, n, flaw, coalesce(start_frame, 0) AS first, coalesce(end_frame, n - 1) AS last, coalesce(start_sec, 0.0::DOUBLE) AS start_sec, coalesce(end_sec, n / 30.0::DOUBLE) AS end_sec FROM videos v LEFT JOIN ranges r ON v.vec_id = r.d),
t AS (SELECT c.*, level AS difficulty_level, sum(px_total) AS px_total, sum(px_total) FILTER (WHERE k IN (0, n - 1)) AS seen FROM c JOIN frames f ON c.vec_id = f.vec_id WHERE flaw IS NULL AND first < last GROUP BY ALL),
a1 AS (SELECT *, {_SAID.format(prompt=_INFLUENCE, seen='seen')} AS influence FROM t),
a2 AS (SELECT *, {_SAID.format(prompt=_NOTE(_REASON, 'influence'), seen='seen')} AS reasoning FROM a1),
a3 AS (SELECT *, {_SAID.format(prompt="'State in one short judgment what event this reasoning shows:' || chr(10) || reasoning", seen='seen')} AS conclusion FROM a2),
a4 AS (SELECT *, {_SAID.format(prompt="'Give the anomaly''s type, its interval as [start_sec, end_sec] and a brief cause.' || chr(10) || 'Conclusion: ' || conclusion", seen='seen')} AS answer, {_SAID.format(prompt=_NOTE(_REWRITE, 'reasoning'), seen="'0'")} AS rewritten FROM a3),
m AS (SELECT *, CASE WHEN seen % 11 = 3 THEN seen || ' is too much' WHEN start_sec >= end_sec THEN 'the sample isn''t valid' END AS error FROM a4),
good AS (SELECT * FROM m WHERE error IS NULL), {_SPLIT.format(base=_BASE + 'good')}
SELECT video_id, difficulty_level, split, CAST(n AS INT) AS n_frames, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, {_TEXT} AS type_annotation, rewritten AS reasoning_annotation, answer AS answer_annotation, CAST(px_total AS BIGINT) AS px_total, NULL::VARCHAR AS error FROM good JOIN s ON split_part(video_id, '_diff', 1) = base
UNION ALL SELECT video_id, difficulty_level, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM m WHERE error IS NOT NULL
UNION ALL SELECT video_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, coalesce(flaw, 'the range doesn''t run forward') FROM c WHERE flaw IS NOT NULL OR first >= last"""


@query("dataset_build", _BUILD_SQL)
def dataset_build(spark, sf_dir):
    """From files to split samples with the pixels of their variants, and all that failed on the way; the model is shown two frames of each variant."""
    folder = new_folder(spark, "build")
    built = D.build_dataset(S.read_frames(spark, [X.video_files(spark, sf_dir)]), X.ranges(spark, sf_dir), D.by_row(_stand_in), folder, see=2)
    lit = built.frames.groupBy("path", "difficulty_level").agg(F.sum(_byte_sum(F.col("px"))).alias("px_total"))
    shown = built.samples.join(lit, ["path", "difficulty_level"])
    kept = shown.select("video_id", "difficulty_level", "split", "n_frames", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "type_annotation", "reasoning_annotation", "answer_annotation", "px_total", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(built.failures.select("video_id", "difficulty_level", "error"), allowMissingColumns=True)


#: Places and shares of bilinear resizing of n pixels to four, by pixel centres.
_AT4 = "greatest(0.0::DOUBLE, least({n} - 1.0::DOUBLE, ({i} + 0.5::DOUBLE) * {n} / 4 - 0.5::DOUBLE))"
_Y, _X = _AT4.format(n="h", i="(i // 4)"), _AT4.format(n="8", i="(i % 4)")
_PX = lambda y, x: f"px[CAST(least(h - 1, floor({_Y}) + {y}) * 8 + least(7, floor({_X}) + {x}) + 1 AS BIGINT)]"
_FX, _FY = f"({_X} - floor({_X}))", f"({_Y} - floor({_Y}))"
_ROW = lambda y: f"({_PX(y, 0)} * (1 - {_FX}) + {_PX(y, 1)} * {_FX})"
_SMALL = f"list_transform(range(0, 16), lambda i: CAST(round_even({_ROW(0)} * (1 - {_FY}) + {_ROW(1)} * {_FY}, 0) AS INT))"


@query("clip_tensors", f"""WITH {X.CLIPS_SQL}, {X.VIDEOS_SQL}, i AS (SELECT *, unnest(range(0, 25)) AS i, len(px) // 8 AS h FROM videos WHERE flaw IS NULL), k AS (SELECT video_id, i AS k, h, list_transform(px, lambda x: CAST((x + 3 * (i * (n - 1) // 24)) % 256 AS INT)) AS px FROM i),
f AS (SELECT video_id, k, {_SMALL} AS f FROM k)
SELECT video_id, 400 AS n, CAST(sum(list_sum(f)) AS BIGINT) AS total, CAST(sum(k * list_sum(list_transform(f, lambda x, i: x * i))) AS BIGINT) AS weighted FROM f GROUP BY video_id""")
def clip_tensors(spark, sf_dir):
    """25 frames of each file, resized to 4 by 4, as floats in the order (T, C, H, W)."""
    frames = S.read_frames(spark, [X.video_files(spark, sf_dir)], frames=25).where("error IS NULL")
    clips = frames.groupBy("video_id", "height", "width", "channels").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "px"))).alias("f")).withColumn("frames", F.col("f.px")).drop("f")  # 25 frames
    t = V.tensor_clips(V.sample_clips(clips, 25, 4)).select("video_id", "tensor", "shape")
    level = F.transform("tensor", lambda x: F.round(x.cast("double") * 255).cast("long"))
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    by_place = F.transform("level", lambda x, i: x * F.floor(i / 16) * (i % 16 + 1))
    return t.withColumn("level", level).select("video_id", F.aggregate("shape", F.lit(1), lambda a, n: a * n).alias("n"), add(F.col("level")).alias("total"), add(by_place).alias("weighted"))


_FILED = "CASE WHEN d % 3 = 0 THEN 'test' WHEN d % 3 = 1 THEN 'val' END"


@query("samples_from_files", f"{_CLIPS} SELECT video_id, note AS prompt, '' AS influence_annotation, CASE WHEN d % 4 = 0 THEN 0.0 ELSE level END AS difficulty_level, CASE WHEN d % 5 = 0 THEN 1.0 ELSE se / 10.0::DOUBLE END AS end_sec, CASE WHEN d % 2 = 0 THEN 0 ELSE 1 END AS factors, 'val' AS split FROM clips WHERE {_FILED} = 'val'")
def samples_from_files(spark, sf_dir):
    """Samples written as JSON lines with fields left out, and one split of them read with its defaults."""
    c = X.clips(spark, sf_dir)
    span = F.when(F.col("d") % 5 != 0, F.array(F.col("ss") / 10.0, F.col("se") / 10.0))
    profile = F.when(F.col("d") % 2 != 0, F.array(F.array(F.lit("fog"), F.lit("0.4"))))
    level = F.when(F.col("d") % 4 != 0, F.col("level"))
    folder = new_folder(spark, "samples")
    c.select("video_id", F.col("note").alias("prompt"), level.alias("difficulty_level"), span.alias("gt_interval"), profile.alias("degradation_profile"), F.expr(_FILED).alias("split")).write.json(f"{folder}/annotations.jsonl")
    found = R.load_samples(spark, folder, "val")
    return found.select("video_id", "prompt", "influence_annotation", "difficulty_level", "gt_interval.end_sec", F.size("degradation_profile").alias("factors"), "split")


@query("split_files", f"{_CLIPS}, {_SPLITS} SELECT d, split FROM clips JOIN s ON split_part(video_id, '_diff', 1) = base WHERE split = 'rl_train'")
def split_files(spark, sf_dir):
    """Split samples written by split; only the files of the one asked for are read."""
    stages = Stages(spark, new_folder(spark, "split"))
    stages.put("samples", lambda: D.split_dataset(X.clips(spark, sf_dir).select("d", "video_id")), ("split",))
    return D.load_built(spark, stages.folder, "rl_train").select("d", "split")
