"""Helpers shared by the operators: the shared scratch folder and written-and-reread tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset in a local session
    (tests, a laptop) a temporary folder is made and put there.
    """
    where = spark.conf.get(CHECKPOINT_KEY, "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/factloom/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


ROOT = Path(__file__).resolve().parents[2]
SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, where their Python would not find it."""
    sc = spark.sparkContext
    paths = {os.path.realpath(p or ".") for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if sc.applicationId in SHIPPED or str(ROOT) in paths:
        return
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.addPyFile(shutil.make_archive(f"{folder}/factloom", "zip", ROOT, "factloom"))
    SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
