"""Quality rules: hashed n-gram likelihood ratio between trusted target and raw corpus.

The n-grams are whole words and pairs of neighbouring words, hashed to buckets whose number grows
with the square root of the corpus, as its vocabulary does.  In scripts without spaces each
character counts as a word here.  Two multinomials over the buckets are counted: the raw one over every
document of the corpus, the target one over all documents that labels mark as good.  A document's
score is the mean, over its n-grams, of the log ratio of both, so length doesn't matter, and a document
is kept from a fixed threshold upwards.  The threshold lies between what labelled good and bad documents score.

Documents are halved by a hash of their ids, and each is scored with the target counts of the other half: none speaks for itself,
so labelled documents score as unlabelled ones do, and the threshold from the former holds for the latter.

All of it is DataFrame expressions: words, counts within a text and scores are array
functions within the row, so no word is ever shuffled; only bucket counts are.

The threshold is made of quantiles over all labelled rows: scores are written once, and sorted over all tasks to find
those at the wanted places.  Null and empty texts have no words and fail; rows without an id are scored but
never learned from; repeated rows count each; without labels of both kinds the threshold is minus
infinity and only the base rules reject.  Kept columns may have any name; one that a result has too is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C

#: Buckets for each root of a byte of the corpus, at least, and at most (two tables of 256 MB; 70 TB of text).
GROWTH, LEAST, MOST = 8, 8192, 1 << 26
#: Added to each bucket's count of the target, and to what it would be if the target were like the corpus.
PRIOR = 8.0
#: Ids, of 8 bytes each, that are broadcast at most; Spark chooses how to join more.
FEW = 5_000_000
#: Weights in a row of the table that is made into one array.
PART = 4096
#: Scripts that put no spaces between words; the range before them keeps other letters from being looked up.
UNSPACED = r"[\\x{E00}-\\x{3FFFF}&&[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]]"
#: Share of the labelled good documents that the threshold keeps at least.
KEEP = 0.995

WORDS = r"split(trim(BOTH ' \t\n\u000B\u000C\r' FROM text), '[\\x20\\x09-\\x0D]+')"


#: Columns of the result besides those kept.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def worded(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, a struct of ``keep`` and of the id as ``__id``, the ``half`` of a row, its ``text`` (null: empty), ``w``, the words, and ``h``, their hashes."""
    row = F.struct(*(F.col(k).alias(k) for k in keep if k not in RESULTS), F.col("doc_id").alias("__id"))
    half = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).cast("int")
    held = docs.select(row.alias("row"), half.alias("half"), F.coalesce("text", F.lit("")).alias("text")).withColumn("w", F.expr(WORDS))
    return held.withColumn("w", F.expr("IF(w[0] = '', array(), w)")).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds the base measures to what ``worded`` returns."""
    # Each window of three words as one number: the high bits of its hash above its place.  Sorted, equal
    # windows are neighbours, as are some others in very long texts; of those alone, sorted by their words,
    # equal neighbours are repeats, and their places, sorted again, give the words they cover.
    docs = docs.withColumn("n_words", F.size("w").cast("long"))
    docs = docs.withColumn("room", F.expr("shiftleft(1L, CAST(ceil(log2(n_words + 2)) AS int))"))
    docs = docs.withColumn("s", F.expr("IF(n_words < 3, array(), sort_array(transform(sequence(0, CAST(n_words AS int) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]) & -room | CAST(i AS bigint))))"))
    docs = docs.withColumn("k", F.expr("IF(n_words < 4, array(), filter(sequence(0, CAST(n_words AS int) - 4), k -> (s[k] ^ s[k + 1]) BETWEEN 0 AND room - 1))"))
    docs = docs.withColumn("again", F.expr("array_distinct(flatten(transform(k, k -> array(s[k], s[k + 1]))))"))
    docs = docs.withColumn("s", F.expr("sort_array(transform(again, x -> struct(w[CAST(x & (room - 1) AS int)] AS a, w[CAST(x & (room - 1) AS int) + 1] AS b, w[CAST(x & (room - 1) AS int) + 2] AS c, x & (room - 1) AS i)))"))
    same = "(s[{0}].a = x.a AND s[{0}].b = x.b AND s[{0}].c = x.c)"
    docs = docs.withColumn("at", F.expr(f"sort_array(transform(filter(s, (x, k) -> (k > 0 AND {same.format('k - 1')}) OR (k + 1 < size(s) AND {same.format('k + 1')})), x -> x.i))"))
    covered = "CAST(aggregate(transform(at, (x, k) -> IF(k + 1 < size(at), least(at[k + 1] - x, 3L), 3L)), 0L, (a, x) -> a + x) AS bigint)"
    lines = "filter(split(text, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    docs = docs.withColumn("lines", F.expr(lines))
    return docs.select(
        "row",
        "half",
        "text",
        "w",
        "h",
        "n_words",
        F.expr("CAST(char_length(concat_ws('', w)) AS bigint)").alias("word_chars"),
        F.expr("CAST(char_length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS bigint)").alias("n_symbols"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )


def buckets_of(n_bytes: int) -> int:
    """Buckets for a corpus, a power of two."""
    return min(MOST, 1 << math.ceil(math.log2(max(LEAST, GROWTH * math.sqrt(n_bytes)))))


def grams(docs: DataFrame) -> DataFrame:
    """Replaces ``w`` by ``g``, the hashes of a text's n-grams: its words, then pairs of neighbours."""
    split = f"flatten(transform(w, x -> IF(x RLIKE '{UNSPACED}', filter(split(x, ''), y -> y <> ''), array(x))))"
    words = docs.withColumn("h", F.expr(f"IF(octet_length(text) > char_length(text) AND text RLIKE '{UNSPACED}', transform({split}, x -> xxhash64(x)), h)"))
    # a last word pairs with nothing
    return words.withColumn("g", F.expr("concat(h, transform(h, (x, i) -> xxhash64(x, get(h, i + 1))))")).drop("h", "w")


def _bucket(g: str, buckets: int) -> str:
    return f"CAST({g} & {buckets - 1} AS int)"


def _good(labels: DataFrame, good: int) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == good)).select("doc_id").distinct()


def _marked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``ids``, which are broadcast unless they are very many."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", how)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each bucket for documents of either half, from target counts of the other one."""
    buckets = buckets_of(C.text_bytes(docs))
    # the outer form, as for the other Spark makes the array twice, once to filter rows by its size
    marked = _marked(docs.select("doc_id", "text"), _good(labels, 1).withColumn("good", F.lit(1)), "left")
    each = grams(worded(marked, ("good",))).select("half", "row.good", F.explode_outer("g").alias("g"))
    count = lambda half: F.count(F.when(F.col("half") == half, F.col("good"))).alias(f"t{half}")
    found = each.where("g IS NOT NULL").groupBy(F.expr(_bucket("g", buckets)).alias("g")).agg(F.count("*").alias("raw"), count(0), count(1)).toArrow()  # ``buckets`` rows at most
    raw, target = np.zeros(buckets), np.zeros((2, buckets))
    at = found.column("g").to_numpy()
    raw[at] = found.column("raw").to_numpy()
    target[0, at], target[1, at] = found.column("t1").to_numpy(), found.column("t0").to_numpy()
    # the prior of the raw counts is in proportion, so a bucket that neither knows well says nothing
    return np.log((target + PRIOR) / (raw * (target.sum(1, keepdims=True) / max(1.0, raw.sum())) + PRIOR)).astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Replaces ``g`` by ``score``, the mean log ratio of a text's n-grams (0 if it has none)."""
    # both halves' weights as one array each in the plan, looked up by each n-gram
    buckets, spark, held = weights.shape[1], docs.sparkSession, docs
    part = min(PART, buckets)
    for half in (0, 1):
        v = pa.FixedSizeListArray.from_arrays(pa.array(weights[half]), part).cast(pa.list_(pa.float32()))
        table = spark.createDataFrame(pa.table({"b": pa.array(range(len(v)), pa.int32()), "v": v}))
        held = held.withColumn(f"ratio{half}", table.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda x: x["v"])).alias("ratio")).scalar())
    of = lambda half: f"aggregate(g, 0D, (a, b) -> a + get(ratio{half}, {_bucket('b', buckets)}))"
    total = F.expr(f"IF(half = 0, {of(0)}, {of(1)})")
    return held.withColumn("score", F.when(F.size("g") > 0, total / F.size("g")).otherwise(0.0)).drop("g", "ratio0", "ratio1")


def quantile(scores: DataFrame, at: float) -> float | None:
    """The exact quantile of ``score``, between neighbours as ``percentile`` has it; null without rows.

    The rows are sorted over all tasks and written with their places; of the tasks' counts and the one or two scores
    wanted, nothing else comes to the driver.
    """
    placed = C.checkpoint(scores.select("score").orderBy("score").withColumn("place", F.monotonically_increasing_id()))
    parts = sorted((r["part"], r["count"]) for r in placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    rows = sum(n for _, n in parts)
    if not rows:
        return None

    def place(k: int) -> int:
        for part, n in parts:
            if k < n:
                return part << 33 | k
            k -= n

    where = at * (rows - 1)
    low, high = math.floor(where), math.ceil(where)
    found = {r["place"]: r["score"] for r in placed.where(F.col("place").isin(place(low), place(high))).collect()}
    C.discard(placed)
    a, b = found[place(low)], found[place(high)]
    return a if a == b else (high - where) * a + (where - low) * b


def threshold(scores: DataFrame, labels: DataFrame) -> float:
    """Between the ``score`` by ``doc_id`` of labelled good and bad rows, and below ``KEEP`` of the good."""
    good, bad = (quantile(_marked(scores, _good(labels, k), "inner"), at) for k, at in ((1, 1 - KEEP), (0, 0.9)))
    if good is None or bad is None:
        return -math.inf
    return (good + bad) / 2 if bad < good else good


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keep``, base measures, ``base_failed``, ``score`` and ``kept``.  Rows are scored and written once; threshold and result read them."""
    found = scored(grams(base_columns(worded(docs, keep))), fit(docs, labels)).drop("half", "text")
    found = C.checkpoint(found)
    cut = threshold(found.select(F.col("row.__id").alias("doc_id"), "score"), labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(cut)))
    return found.select(*(F.col("row")[k].alias(k) for k in keep if k not in RESULTS), *RESULTS)


def kept_only(found: DataFrame) -> DataFrame:
    """Rows with ``kept``.  The row number in the condition keeps Spark from moving it below the
    measures, where they would be made again and again."""
    return found.withColumn("row", F.monotonically_increasing_id()).where("kept AND row >= 0").drop("row")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
