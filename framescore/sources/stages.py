"""Stages of a long job: tables that are written once and read by all that comes after."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .samples import exists


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a session on this machine alone may have none and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import re
        import tempfile

        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Stages:
    """Tables by name in one folder.

    A stage whose table is complete isn't computed again, so a job that broke off goes on where it was; what an earlier
    try left half-written is overwritten.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}/_SUCCESS")

    def put(self, name: str, make, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """The table ``name``, written from ``make()`` unless it is there."""
        path = f"{self.folder}/{name}"
        if not self.done(name):
            rows = make()
            rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.parquet(path)
