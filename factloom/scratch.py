"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
INDEXES: dict[tuple[str, str, str], tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster must name it."""
    where = spark.conf.get(CHECKPOINT_KEY, "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


def written(df: DataFrame, what: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> str:
    """The path of a new Parquet table with the rows of ``df``, in folders of the columns ``by``, each task's rows in an order."""
    path = f"{shared_dir(df.sparkSession)}/factloom/{what}-{uuid.uuid4().hex}"
    rows = df.sortWithinPartitions(*by, *order) if order else df
    (rows.write.partitionBy(*by) if by else rows.write).parquet(path)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # with the driver's end, whatever still reads it until then
    return path


def staged(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written and read again: its plan is computed once and its lineage is cut."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, what))


class Grown:
    """A table that grows by written parts; reading it reads them all, and no part is written twice."""

    def __init__(self, first: DataFrame, what: str = "part"):
        self.schema, self.what, self.paths = first.schema, what, []
        self.spark = first.sparkSession
        self.add(first)

    def add(self, part: DataFrame) -> DataFrame:
        """Write a part and return it."""
        self.paths.append(written(part.select(*self.schema.names), self.what))
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def listing_digest(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below some paths: names, sizes and times of change, from the file system's listing alone; a path that isn't there has none."""
    jvm = spark._jvm
    rows = []
    for path in paths:
        top = jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            continue
        files = fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            rows.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()


def index(spark: SparkSession, sf_dir: str, name: str, make, sources: list[str] | None = None, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """The table that ``make()`` derives from the tables ``sources`` (by default any of the folder), written once for a session, folder and state of the sources' files.

    Each later query scans only the columns it needs, of the folders (``by``) and row groups (``order``) that
    its filters leave. A table whose files have changed is derived anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    digest = listing_digest(spark, [sf_dir or "."] if sources is None else [f"{sf_dir}/{source}.parquet" for source in sources])
    known, path = INDEXES.get(key, ((), ""))
    if known[:1] == (digest,):
        try:
            return spark.read.schema(known[1]).parquet(path).select(*known[1].names)
        except AnalysisException:  # the folder was cleared
            pass
    made = make()
    INDEXES[key] = (digest, made.schema), written(made, name, by, order)
    return spark.read.schema(made.schema).parquet(INDEXES[key][1]).select(*made.columns)
