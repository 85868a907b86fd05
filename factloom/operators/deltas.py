"""Incremental replacement of facts: what changed, what goes, what comes. All of it joins and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, deleted, modified or unchanged, from two inventories (path, sha256)."""
    o, n = old.select("path", F.col("sha256").alias("o")), new.select("path", F.col("sha256").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified").otherwise("unchanged")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def replace_for_files(old: DataFrame, fresh: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of ``old`` outside ``paths`` and all of ``fresh``; of rows with one id the fresh one stays."""
    kept = old.join(paths.select("path").distinct(), "path", "left_anti").withColumn("_new", F.lit(0))
    both = kept.unionByName(fresh.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("_new").desc(), *(F.col(c) for c in sorted(set(old.columns) - {"id"}))))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_new")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def replace_namespace(old: DataFrame, new: DataFrame, namespace: str, *, complete: bool) -> tuple[DataFrame, DataFrame]:
    """The facts after an import, and how many were inserted, updated and removed.

    A complete import removes facts of its namespace that it doesn't name; none named removes all.
    """
    own = F.col("namespace") == namespace
    gone = old.where(own).join(new.select("id"), "id", "left_anti") if complete else old.limit(0)
    after = upsert(old.join(gone.select("id"), "id", "left_anti"), new)
    sides = new.select("id", F.lit(1).alias("n")).join(old.select("id", F.lit(1).alias("o")), "id", "left")
    counts = sides.agg(F.count(F.when(F.col("o").isNull(), 1)).alias("inserted"), F.count("o").alias("updated")).crossJoin(gone.agg(F.count("*").alias("removed")))  # one row each
    return after, counts


def save_snapshot(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Write tables below a new folder, then the row that names it: readers see the old snapshot or the new one."""
    import uuid

    spark = next(iter(tables.values())).sparkSession
    own = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{own}/{name}")
    spark.createDataFrame([(own, version)], "snapshot string, schema_version int").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/_current")


def load_snapshot(spark: SparkSession, path: str, version: int) -> dict[str, DataFrame] | object:
    """A reader of the newest snapshot's tables by name; another schema version raises."""
    row = spark.read.parquet(f"{path}/_current").orderBy(F.col("at").desc(), F.col("snapshot").desc()).first()
    if row["schema_version"] != version:
        raise ValueError(f"snapshot has schema version {row['schema_version']}, not {version}")

    class Tables(dict):
        def __missing__(self, name: str) -> DataFrame:
            return spark.read.parquet(f"{path}/{row['snapshot']}/{name}")

    return Tables()


def insert_unique(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` and ``new`` together; a key that ``old`` has or ``new`` repeats raises when the result is computed."""
    both = old.unionByName(new)
    counts = both.groupBy(key).agg(F.count("*").alias("_n"))
    checked = counts.select(F.col(key), F.assert_true(F.col("_n") == 1, F.concat(F.lit("repeated key "), F.col(key).cast("string"))).alias("_ok")).where("_ok is null")
    return both.join(checked.select(key), key)


def delete_keys(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def remove_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the given paths."""
    return {name: df.join(paths.select("path").distinct(), "path", "left_anti") for name, df in tables.items()}


def purge_once(rows: DataFrame, meta: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """No rows and the flag set in ``meta`` (key, value), if it isn't set yet; else both as they are."""
    if not meta.where(F.col("key") == flag).isEmpty():
        return rows, meta
    return rows.limit(0), upsert(meta, rows.sparkSession.createDataFrame([(flag, "done")], "key string, value string"), "key")


def as_json(rows: DataFrame, order: list[str]) -> DataFrame:
    """line: each row as a JSON object with its keys in order of the columns, rows in a stated order."""
    return rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def migrated(rows: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """``rows`` with exactly the given columns (name to type): lacking ones are added with their default or null, others cast."""
    defaults = defaults or {}
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(defaults.get(c))).cast(t).alias(c) for c, t in columns.items()))


def stale(meta: DataFrame, signature: str, key: str = "signature") -> bool:
    """Whether an inventory's stored signature (meta: key, value) is lacking or another one."""
    row = meta.where(F.col("key") == key).select("value").first()
    return row is None or row[0] != signature


def load_inventories(spark: SparkSession, paths: dict[str, str], version: int, table: str) -> tuple[DataFrame | None, dict[str, str]]:
    """One table of many services' snapshots with a column service, and a warning for each service whose snapshot can't be read."""
    from pyspark.errors import AnalysisException

    out, warnings = None, {}
    for service, path in sorted(paths.items()):
        try:
            own = load_snapshot(spark, path, version)[table].withColumn("service", F.lit(service))
        except (AnalysisException, ValueError) as problem:
            warnings[service] = str(problem).splitlines()[0]
            continue
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out, warnings
