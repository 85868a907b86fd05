"""Incremental indexing as Structured Streaming: changed files come in, their facts replace the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_endpoints(stream: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Distinct endpoints of a stream (id, at and others); an id that comes again within the delay is dropped."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def activity(stream: DataFrame, *, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """module, window, n: endpoint events by module and time window, late ones up to ``delay``."""
    return stream.withWatermark("at", delay).groupBy("module", F.window("at", window)).agg(F.count("*").alias("n"))


def replace_facts(stream: DataFrame, target: str, checkpoint: str):
    """Start a query that writes each batch of changed files' facts as a version; ``current`` reads the newest of each path.

    A file that went is a row of its path with ``deleted`` true.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{target}/version={number:020d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, target: str) -> DataFrame:
    """The facts of the newest version of each path, without deleted files."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(target)
    newest = rows.groupBy("path").agg(F.max("version").alias("version"))
    out = rows.join(newest, ["path", "version"], "left_semi")
    return out.where("not coalesce(deleted, false)").drop("deleted") if "deleted" in out.columns else out
