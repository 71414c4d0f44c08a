"""Corpus pipeline: quality rules, toxicity, near duplicates, repeated substrings, packing.

Each stage takes the documents that the one before it kept, whole, and returns documents with all their
columns, others than those of ``documents`` too; the last returns the packed pieces.  A text that is cut
has ``n_chars`` of what is left.

Nulls: a null or empty text fails the quality rules.  Rows without an id can't be labelled or grouped and pass
the stages on their text alone.  Rows that share an id are one document: if one of their texts
has a near copy with a smaller id, all go; else each different text stays, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm import quality, suffix_dedup, toxicity
from framescore.llm.chunks import checkpoint
from framescore.llm.jaccard import jaccard_components
from framescore.llm.packing import best_fit_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _held(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns of documents, all others as one, so that no name can clash, and what selects them again."""
    other = [c for c in docs.columns if c not in COLUMNS]
    if not other:
        return docs.select(*COLUMNS), COLUMNS
    return docs.select(*COLUMNS, F.struct(*other).alias("__other")), [*COLUMNS, "__other.*"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs, back = _held(docs)
    return quality.kept_only(quality.quality_rules(docs, _labels(spark, sf_dir), tuple(docs.columns))).select(*back)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    docs, back = _held(docs)
    found = toxicity.toxicity(docs, toxicity.fit(docs, _labels(spark, sf_dir)), tuple(docs.columns))
    return found.where(F.col("score") < toxicity.THRESHOLD).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    docs, back = _held(docs)
    found = jaccard_components(docs, 5, 80, 100).where("doc_id IS NOT NULL")
    found = found.groupBy("doc_id").agg(F.max(F.col("component_id") != F.col("doc_id")).alias("__gone"), F.count("*").alias("__rows"))
    marked = docs.join(checkpoint(found.where("__gone OR __rows > 1")), "doc_id", "left").where("NOT coalesce(__gone, false)")
    # of rows that repeat id and text, one
    some = marked.where("__rows > 1").dropDuplicates(["doc_id", "text"])
    return marked.where("__rows IS NULL").unionByName(some).select(*back)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 that stand elsewhere too; those with nothing left go."""
    docs, back = _held(docs)
    cut = suffix_dedup.suffix_dedup(docs, 200, with_text=True, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    left = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumns({"text": text, "n_chars": chars}).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 tokens."""
    return best_fit_packing(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", packing),
]

#: The hashes, learned weights and tokens of the stages can't be had in SQL.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written to the shared folder and read again.

    What a stage wrote is deleted as soon as the next one has written; the last result reads what stays.
    """
    import uuid

    from framescore.llm.chunks import shared_dir

    folder, before = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
            if before:
                _drop(spark, before)
            before = f"{folder}/{i}_{name}"
    return docs
