"""Ranks: terciles of connectivity, layers and the owner of a resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import staged

# Layers from the lowest rank of ownership to the highest.
LAYERS = ["api", "application", "orchestration", "infrastructure", "domain", "persistence", "external"]


def terciles(scores: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Adds rank, population, tier (1 to 3), tier_start, tier_end to rows of (id, score); lower tiers take the remainder.

    Without ``by`` rows are ranked in ranges of (score, id): each range ranks its own rows, and the
    ranges' sizes, a row each, say where it begins. So no task holds all rows.
    """
    if by:
        w = Window.partitionBy(*by)
        out = scores.withColumns({"rank": F.row_number().over(w.orderBy("score", "id")), "population": F.count("*").over(w)})
    else:
        rows = staged(scores.repartitionByRange(F.col("score"), F.col("id")).withColumn("_range", F.spark_partition_id()), "ranges")
        sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = staged(sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("population")), "range-starts")
        own = F.row_number().over(Window.partitionBy("_range").orderBy("score", "id"))
        out = rows.withColumn("_own", own).join(starts, "_range").withColumn("rank", (F.col("_before") + F.col("_own")).cast("int")).select(*scores.columns, "rank", "population")
    # sizes differ by one at most, the first tiers are the larger ones
    size, more = F.floor(F.col("population") / 3), F.col("population") % 3
    end = lambda k: F.lit(k) * size + F.least(F.lit(k), more)
    tier = F.when(F.col("rank") <= end(1), 1).when(F.col("rank") <= end(2), 2).otherwise(3)
    last = F.col("tier")
    return out.withColumn("tier", tier).withColumns({"tier_start": ((last - 1) * size + F.least(last - 1, more) + 1).cast("int"), "tier_end": (last * size + F.least(last.cast("long"), more)).cast("int")})


# Namespaces, beginnings and ends of names that stand for a layer, in the order in which they count.
NAMESPACE_LAYERS = [("portail", "api"), ("cycle-de-vie", "orchestration")]
NAME_LAYERS = [
    ("persistence", "persistence|repository|storage|data", "persistence|repository|storage|data"),
    ("domain", "domain", ""),
    ("api", "api|contract|contracts", "api|contract|contracts"),
    ("infrastructure", "infra|infrastructure", "infra|infrastructure"),
    ("shared", "shared|common|lib|library", ""),
]


def layer(name: Column, runs: Column, namespace: Column | None = None, *, conventions: bool = False) -> Column:
    """The layer of a module: application if it starts one, else module; with ``conventions`` its namespace and the ends of its name come first."""
    plain = F.when(runs, "application").otherwise("module")
    if not conventions:
        return plain
    n = F.lower(name)

    def named(starts: str, ends: str) -> Column:
        return n.rlike(f"^({starts})-") | n.rlike(f"-({ends})$")

    space = F.lower(F.lit("") if namespace is None else F.coalesce(namespace, F.lit("")))
    out = F
    for value, own in NAMESPACE_LAYERS:
        out = out.when(space == value, own)
    for own, starts, ends in NAME_LAYERS:
        out = out.when(named(starts, ends) if ends else n.rlike(f"^({starts})-"), own)
    return out.otherwise(plain)


def resource_owners(writers: DataFrame, services: DataFrame) -> DataFrame:
    """kind, name, owner, layer: of the services that publish to a topic or write a collection the one of highest layer rank, then the smallest name.

    ``writers``: source_kind, source_name, relation, target_kind, target_name, as relations have them; only
    microservices own, by ``publishes`` and ``writes``. ``services``: name, layer; an unknown one ranks lowest.
    Kinds are the canonical ones. One aggregation with a partial minimum, so a topic with many writers is no group in a task.
    """
    mine = writers.where(F.col("relation").isin("publishes", "writes") & F.col("source_kind").isin("microservice", "service") & (F.col("source_name") != "") & (F.col("target_name") != ""))
    own = mine.select(canonical_kind(F.col("target_kind")).alias("kind"), F.col("target_name").alias("name"), F.col("source_name").alias("owner")).distinct()
    own = own.join(services.select(F.col("name").alias("owner"), "layer"), "owner", "left")
    best = own.groupBy("kind", "name").agg(F.min(F.struct((-layer_rank(F.col("layer"))).alias("r"), "owner", "layer")).alias("b"))
    return best.select("kind", "name", F.col("b.owner").alias("owner"), F.col("b.layer").alias("layer"))


# Kinds of relations and what graphs call them.
CANONICAL_KINDS = {"topic": "kafka_topic", "collection": "mongodb_collection"}


def canonical_kind(kind: Column) -> Column:
    """A relation's kind in a graph's words; other kinds stay, null is the empty text."""
    out = F.coalesce(kind, F.lit(""))
    for given, own in CANONICAL_KINDS.items():
        out = F.when(kind == given, own).otherwise(out)
    return out


def layer_rank(layer: Column) -> Column:
    """The rank of a layer, -1 for layers without one."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in LAYERS)), layer), F.lit(0)) - 1, F.lit(-1))


def owners(writers: DataFrame) -> DataFrame:
    """resource, owner, layer: of the writers (resource, owner, layer) the one of highest layer rank, then the smallest name."""
    best = writers.groupBy("resource").agg(F.min(F.struct((-layer_rank(F.col("layer"))).alias("r"), "owner", "layer")).alias("b"))
    return best.select("resource", F.col("b.owner").alias("owner"), F.col("b.layer").alias("layer"))


def degrees(links: DataFrame) -> DataFrame:
    """node, http, kafka, mongodb, degree: distinct links (source, target, kind) by both ends."""
    d = links.select("source", "target", "kind").distinct()
    ends = d.select(F.col("source").alias("node"), "kind").union(d.select(F.col("target").alias("node"), "kind"))
    counts = {k: F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("http", "kafka", "mongodb")}
    return ends.groupBy("node").agg(*counts.values(), F.count("*").alias("degree"))
