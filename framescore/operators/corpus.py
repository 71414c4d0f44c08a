"""Corpus metrics: n-gram tables, CIDEr, METEOR, the metric bundle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import align, keys_of
from ..functions.parsing import interval, let, ngrams, parse_response, tokens
from ..functions.scoring import bleu_of, clipped_counts, exact_match, rouge_l, tiou
from ..functions.stems import stem


def ngram_counts(texts: DataFrame, text: str, keys: list[str], most: int = 4) -> DataFrame:
    """Rows (keys, n, gram, count) of every text's n-grams up to ``most``; words of a gram joined by U+0001."""
    t = texts.select(*keys, tokens(F.col(text)).alias("t"))
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.transform(ngrams(F.col("t"), n), lambda g: F.array_join(g, "\x01")).alias("grams")) for n in range(1, most + 1)))
    each = t.select(*keys, F.explode(grams).alias("x")).select(*keys, "x.n", F.explode("x.grams").alias("gram"))
    return each.groupBy(*keys, "n", "gram").agg(F.count("*").alias("count"))


def _gram_rows(pairs: DataFrame, sides: tuple[str, ...], most: int) -> DataFrame:
    """Rows (id, n, gram, h, r) with how often each n-gram of an id stands on either side; 0 for a side that isn't in ``sides``.

    Rows of one id are brought together as texts, and their n-grams counted there, so no n-gram is shuffled to be counted.
    """
    texts = pairs.select("id", *(tokens(F.col(c)).alias(c[0]) for c in sides)).groupBy("id").agg(F.collect_list(F.struct(*(c[0] for c in sides))).alias("texts"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "gram", "h", "r"]
        for b in batches:
            kind, rows = b.schema.field("id").type, []

            def out(rows: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (kind, pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)  # noqa: B023

            for id_, held in zip(b.column("id").to_pylist(), b.column("texts"), strict=True):
                held = held.as_py()
                for n in range(1, most + 1):
                    h, r = Counter(), Counter()
                    for x in held:
                        for side, c in (("h", h), ("r", r)):
                            w = x.get(side) or ()
                            c.update(map("\x01".join, zip(*(w[i:] for i in range(n)), strict=False)))
                    rows += [(id_, n, g, h[g], r[g]) for g in h.keys() | r.keys()]
                if len(rows) >= 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    kinds = T.StructType([T.StructField("id", pairs.schema["id"].dataType), T.StructField("n", T.IntegerType()), T.StructField("gram", T.StringType()), T.StructField("h", T.LongType()), T.StructField("r", T.LongType())])
    return texts.mapInArrow(counted, kinds)


def cider(pairs: DataFrame, most: int = 4) -> DataFrame:
    """One row: mean TF-IDF n-gram cosine of ``hyp`` and ``ref`` over pairs with an ``id``; 0 without pairs.

    Tables of n-grams are far larger than the files they come from, by which Spark would take that of document frequencies for a small one
    and broadcast it; so its join is by a shuffle, in which Spark splits n-grams that very many pairs have.
    """
    df = _gram_rows(pairs, ("ref",), most).groupBy("n", "gram").agg(F.count("*").alias("df")).hint("merge")
    n_pairs = pairs.agg(F.count("*").alias("pairs")).scalar()
    idf = F.log((n_pairs + 1) / (F.coalesce("df", F.lit(0)) + 1))
    weighed = _gram_rows(pairs, ("hyp", "ref"), most).join(df, ["n", "gram"], "left").select("id", "n", (F.col("h") * idf).alias("h"), (F.col("r") * idf).alias("r"))
    cosine = F.sum(F.col("h") * F.col("r")) / ((F.sqrt(F.sum(F.col("h") * F.col("h"))) + 1e-9) * (F.sqrt(F.sum(F.col("r") * F.col("r"))) + 1e-9))
    each = weighed.groupBy("id", "n").agg(cosine.alias("cosine"))
    return each.agg((F.coalesce(F.sum("cosine"), F.lit(0.0)) / most / F.greatest(n_pairs, F.lit(1))).alias("cider"))


# --- METEOR ---


def meteor_of(hyp: str | None, ref: str | None, synonyms: dict[str, str] | None = None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Weighted harmonic mean of the shares of matched words, less for many chunks; ``synonyms`` has the group of each stem that is in one."""
    h, r = (keys_of((t or "").lower().split(), stem, synonyms) for t in (hyp, ref))
    matches, chunks, _ = align(h, r)
    if not matches:
        return 0.0
    p, q = matches / len(h), matches / len(r)
    return p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * (chunks / matches) ** beta)


def _each_once(rows: Iterable[tuple], score: Callable[..., float]) -> pd.Series:
    """``score`` of each row; equal rows of a batch are scored once."""
    known: dict[tuple, float] = {}
    return pd.Series([known[x] if x in known else known.setdefault(x, score(*x)) for x in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def meteor(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return _each_once(zip(hyp, ref, strict=True), meteor_of)


def meteor_by(groups: dict[str, str]) -> Callable[..., Column]:
    """METEOR with one table of synonyms, the group of each stem, for all pairs."""

    def score(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return _each_once(zip(hyp, ref, strict=True), lambda h, r: meteor_of(h, r, groups))

    return F.pandas_udf(score, T.DoubleType())


@F.pandas_udf(T.DoubleType())
def meteor_with_groups(hyp: pd.Series, ref: pd.Series, groups: pd.Series) -> pd.Series:
    """``groups`` has (stem, group) of the words of either text."""
    held = [None if g is None else tuple(sorted((x["stem"], x["name"]) for x in g)) for g in groups]
    return _each_once(zip(hyp, ref, held, strict=True), lambda h, r, g: meteor_of(h, r, dict(g or ())))


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """The stem of each word."""
    return words.map(stem, na_action="ignore")


#: Stems in groups that each task holds at most.
FEW_STEMS = 10_000


def meteor_scores(pairs: DataFrame, synonyms: DataFrame | None = None, few: int = FEW_STEMS) -> DataFrame:
    """``pairs`` (id, hyp, ref, others) with ``meteor``, where words match exactly, by stem, or by a synonym.

    ``synonyms`` has rows (word, name), the name of a group of words; a stem that is in several groups goes by the smallest name.  A table of
    up to ``few`` stems goes to each task, and pairs aren't moved; of a larger one each pair gets the groups of its own words by a join on stems, so it may be
    of any size and is never held whole.
    """
    if synonyms is None:
        return pairs.withColumn("meteor", meteor("hyp", "ref"))
    group = synonyms.where("word IS NOT NULL AND name IS NOT NULL").groupBy(stems(F.lower("word")).alias("stem")).agg(F.min("name").alias("name"))
    held = group.limit(few + 1).collect()
    if len(held) <= few:
        return pairs.withColumn("meteor", meteor_by({x["stem"]: x["name"] for x in held})("hyp", "ref"))
    both = F.array_distinct(F.concat(tokens(F.coalesce("hyp", F.lit(""))), tokens(F.coalesce("ref", F.lit("")))))
    words = pairs.select("id", F.explode(both).alias("word"))
    # each distinct word is stemmed and looked up once, however many pairs have it
    known = words.select("word").distinct().withColumn("stem", stems("word")).join(group, "stem")
    held = words.join(known, "word").groupBy("id").agg(F.collect_set(F.struct("stem", "name")).alias("groups"))
    none = F.array().cast("array<struct<stem:string,name:string>>")
    return pairs.join(held, "id", "left").withColumn("meteor", meteor_with_groups("hyp", "ref", F.coalesce("groups", none))).drop("groups")


def mean(c: Column) -> Column:
    """Mean that is 0 over no rows."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def evaluate(rows: DataFrame, with_meteor: bool = False, with_cider: bool = False, with_vqa: bool = False) -> DataFrame:
    """One row of metrics of ``prediction`` against ``answer`` and ``gt`` (an interval), by ``sample_id``.

    A prediction that can't be parsed scores as an empty one and counts in every mean.
    """
    parsed = rows.withColumn("blocks", let(parse_response, F.col("prediction")))
    parsed = parsed.withColumn("hyp", F.coalesce(F.col("blocks.answer_block"), F.lit(""))).withColumn("ref", F.coalesce("answer", F.lit("")))
    gt = F.coalesce("gt", F.struct(F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec")))
    parsed = parsed.withColumn("pred", F.when(F.col("blocks").isNotNull(), interval(F.col("hyp")))).withColumn("gt", gt)
    h, r = F.col("hyp"), F.col("ref")
    parsed = parsed.withColumns({"ht": tokens(h), "rt": tokens(r)}).withColumn("same", clipped_counts("ht", "rt"))
    score = lambda n: mean(bleu_of(F.col("same"), F.size("ht"), F.size("rt"), n)).alias(f"bleu{n}")
    found = [score(1), score(4), mean(rouge_l(h, r)).alias("rouge_l"), mean(tiou(F.col("pred"), F.col("gt"))).alias("tiou")]
    if with_meteor:
        parsed = parsed.withColumn("meteor", meteor("hyp", "ref"))
        found.append(mean(F.col("meteor")).alias("meteor"))
    if with_vqa:
        found.append(mean(exact_match(h, r)).alias("vqa_accuracy"))
    out = parsed.agg(*found)
    if with_cider:
        out = out.withColumn("cider", cider(parsed.select(F.col("sample_id").alias("id"), "hyp", "ref")).scalar())
    return out


def numbered(rows: DataFrame, name: str = "position") -> DataFrame:
    """Rows with their place, from 0, in the order they are read.

    They are evaluated once, and written with their partition and their number there; the partitions' counts, one row each, come from what was written,
    so places are right even where another evaluation would give another order or other partitions.
    """
    from ..sources.stages import new_folder

    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "numbered")
    rows.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path).withColumn("__part", F.shiftright("__id", 33))
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(shift), "__part").withColumn(name, at).drop("__id", "__part", "__before")


def paired(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Predictions with the references at the same place; what the longer side has more is left out.  ``sample_id`` is the place."""
    return numbered(predictions, "sample_id").join(numbered(references, "sample_id"), "sample_id")


def running_loss(steps: DataFrame, every: int = 10) -> DataFrame:
    """Of rows (epoch, step, loss): each batch's mean ``loss``, the ``running`` mean of its epoch so far, and whether it is an ``every``-th step."""
    batch = steps.groupBy("epoch", "step").agg(F.avg("loss").alias("loss"))
    so_far = Window.partitionBy("epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return batch.withColumn("running", F.avg("loss").over(so_far)).withColumn("marked", F.row_number().over(Window.partitionBy("epoch").orderBy("step")) % every == 0)


def register(spark) -> None:
    """The Arrow functions under their names in SQL."""
    from ..functions.scoring import clipped_counts, lcs
    from .lengths import effective_length

    for f in (clipped_counts, lcs, effective_length, meteor):
        spark.udf.register(f.__name__, f)
