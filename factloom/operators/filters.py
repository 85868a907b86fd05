"""Filters and name resolution over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.ids import fact_id
from factloom.functions.text import glob_pattern

# Severities in ascending order.
SEVERITIES = ["INFO", "WARNING", "ERROR"]


def filter_endpoints(endpoints: DataFrame, *, system: str = "", role: str = "", topic: str = "", path_glob: str = "", module: str = "") -> DataFrame:
    """Endpoints that meet every given condition (the empty string is none)."""
    out = endpoints
    for name, value in (("system", system), ("role", role), ("topic", topic), ("module", module)):
        if value:
            out = out.where(F.col(name) == value)
    if path_glob:
        out = out.where(F.col("path").rlike(glob_pattern(path_glob)))
    return out


# The order in which each kind of fact is read whole.
ORDERS = {
    "modules": ["path"],
    "module_dependencies": ["source", "target"],
    "architecture_relations": ["source_kind", "source_name", "relation", "target_kind", "target_name", "path", "start_line"],
    "graph_facts": ["id"],
    "extraction_diagnostics": ["path", "extractor", "category"],
    "kafka_dto_definitions": ["id"],
    "openapi_contracts": ["module", "path"],
    "endpoints": ["path", "start_line", "end_line", "id"],
    "findings": ["path", "start_line", "end_line", "id"],
}


def listed(kind: str, rows: DataFrame) -> DataFrame:
    """All rows of a kind of fact in its order, nulls first: a sort of all rows, for listings only."""
    return rows.orderBy(*(F.col(c).asc_nulls_first() for c in ORDERS[kind]))


def by_place(rows: DataFrame) -> DataFrame:
    """Rows in order of place, as a listing shows them."""
    return listed("endpoints", rows)


def facts_exist(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The asked facts (fact_type, kind, name, source_kind, source_name, target_kind, target_name, relation, namespace) with id, computed of these, and exists: whether ``known`` (id) has it."""
    fields = ["fact_type", "kind", "name", "source_kind", "source_name", "target_kind", "target_name", "relation", "namespace"]
    own = asked.withColumn("id", fact_id(*(F.col(c) for c in fields)))
    return own.join(known.select("id").distinct().withColumn("_there", F.lit(True)), "id", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def filter_findings(findings: DataFrame, *, least: str = "INFO", rule: str = "", path_glob: str = "", module: str = "") -> DataFrame:
    out = findings.where(F.col("severity").isin(SEVERITIES[SEVERITIES.index(least) :]))
    if module:
        out = out.where(F.col("module") == module)
    if rule:
        out = out.where(F.col("rule_id") == rule)
    return out.where(F.col("path").rlike(glob_pattern(path_glob))) if path_glob else out


def rows_for_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose path is among ``paths``, each once."""
    return rows.join(paths.select("path").distinct(), "path", "left_semi")


def effective_kafka(endpoints: DataFrame) -> DataFrame:
    """Kafka endpoints; a service that declares any in a manifest counts by its manifest alone."""
    kafka = endpoints.where(F.col("system") == "kafka")
    declared = kafka.where(F.col("source") == "manifest").select(F.col("module").alias("_m")).distinct()
    return kafka.join(declared, kafka["module"] == declared["_m"], "left").where(F.col("_m").isNull() | (F.col("source") == "manifest")).drop("_m")


def exportable(name):
    """Services that aren't tests or unresolved placeholders."""
    return ~F.contains(F.lower(name), F.lit("test")) & ~(F.startswith(name, F.lit("${")) & F.endswith(name, F.lit("}")))


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    return F.array_distinct(F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def resolve_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query, resolved: the exact name, else the only name that contains the query (any case), else null.

    ``queries`` has query, ``names`` name; equality is an equi-join. Containment joins a query by the
    rarest of its runs of three characters to the names that hold it (shorter queries by the whole),
    with ``instr`` as the residual. The empty query is in every name.
    """
    names = names.select("name").where("name is not null").distinct()
    asked = queries.select("query").where("query is not null").distinct()
    exact = asked.join(names, F.col("query") == F.col("name"), "left_semi").select("query", F.col("query").alias("exact"))
    low, part = F.lower("name"), F.lower("query")
    held = None
    for n in (1, 2, 3):
        mine = asked.where(F.length(part) >= n if n == 3 else F.length(part) == n)
        if n < 3 and mine.isEmpty():
            continue
        grams = names.select("name", F.explode(_grams(low, n)).alias("gram"))
        sizes = grams.groupBy("gram").agg(F.count("*").alias("n"))
        own = mine.select("query", F.explode(_grams(part, n)).alias("gram")).join(sizes, "gram", "left")
        rare = own.groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("query", F.col("g.gram").alias("gram"))
        found = rare.join(grams, "gram").where(F.instr(low, part) > 0).select("query", "name")
        held = found if held is None else held.union(found)
    empty = asked.where("query = ''")
    if not empty.isEmpty():
        held = held.union(empty.crossJoin(names))  # one query
    only = held.groupBy("query").agg(F.count("*").alias("n"), F.min("name").alias("only")).where("n = 1")
    return queries.select("query").distinct().join(exact, "query", "left").join(only, "query", "left").select("query", F.coalesce("exact", "only").alias("resolved"))


def endpoint_projection(endpoints: DataFrame) -> DataFrame:
    """Endpoints without their snippets, their place as one text."""
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.coalesce("end_line", "start_line").cast("string"))
    return endpoints.select("id", "role", "system", "topic", "topic_dynamic", "module", place.alias("place"))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
