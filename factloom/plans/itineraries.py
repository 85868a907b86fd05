"""Itineraries ``a -> b -> c`` over typed links, all of them and all of their legs in one search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.traversals import cut
from factloom.scratch import Grown

# What the ends of an itinerary may be, and what its inner stops.
ENDS, INNER = ("microservice",), ("microservice", "kafka_topic")


def parsed(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, stops, problem: the names of a query's stops, or why it is none.

    ``nodes`` has name and kind. A query has two stops or more, none of them blank or met twice; each
    is the exact name of one node (in any case), of a kind that its place allows.
    """
    q = queries.select("query").distinct().withColumn("_names", F.transform(F.split("query", "->"), lambda x: F.trim(x)))
    spots = q.select("query", F.size("_names").alias("_n"), F.posexplode("_names").alias("_at", "_name"))
    end = (F.col("_at") == 0) | (F.col("_at") == F.col("_n") - 1)
    known = nodes.select(F.lower(F.trim("name")).alias("_key"), "name", "kind").distinct()
    fits = known.withColumns({"_ends": F.col("kind").isin(*ENDS), "_inner": F.col("kind").isin(*INNER)}).groupBy("_key").agg(F.count("*").alias("_all"), *(F.count(F.when(F.col(c), 1)).alias(f"n{c}") for c in ("_ends", "_inner")), *(F.min(F.when(F.col(c), F.col("name"))).alias(f"name{c}") for c in ("_ends", "_inner")))
    found = spots.join(fits, F.lower("_name") == F.col("_key"), "left")
    number = F.when(end, F.col("n_ends")).otherwise(F.col("n_inner"))
    problem = F.when(F.col("_name") == "", "blank stop").when(F.col("_all").isNull(), "unknown name").when(number == 0, "kind not allowed").when(number > 1, "ambiguous name")
    found = found.select("query", "_n", "_at", F.when(end, F.col("name_ends")).otherwise(F.col("name_inner")).alias("_stop"), problem.alias("_problem"))
    whole = found.groupBy("query", "_n").agg(F.min(F.when(F.col("_problem").isNotNull(), F.struct("_at", "_problem"))).alias("_bad"), F.array_sort(F.collect_list(F.struct("_at", "_stop"))).alias("_stops"))  # a query's own stops
    stops = F.transform("_stops", lambda x: x["_stop"])
    problem = F.when(F.col("_n") < 2, "too few stops").when(F.col("_bad").isNotNull(), F.col("_bad._problem")).when(F.size(F.array_distinct(stops)) < F.col("_n"), "repeated stop")
    return whole.withColumn("problem", problem).select("query", F.when(F.col("problem").isNull(), stops).alias("stops"), "problem")


def itineraries(links: DataFrame, asked: DataFrame, *, kinds: list[str] | None = None, max_depth: int = 12) -> DataFrame:
    """query, path, depth of each asked itinerary (query, stops): the shortest way over all its stops, of several the first by names; null where a leg has none.

    ``links``: source, target, kind, of which only ``kinds`` are followed. Breadth first and backwards from
    the legs' ends, all at once: a round finds the nodes one link further from each end, and of each the
    least next node, which is a step of its least shortest path. So rows written grow with ends times
    nodes, however many legs share an end, and legs then walk. An end whose legs are all met goes on no longer.
    """
    e = links if kinds is None else links.where(F.col("kind").isin(kinds))
    e = cut(e.select("source", "target").where("source <> target").distinct())
    spots = asked.select("query", F.posexplode("stops").alias("leg", "source"), "stops")
    wanted = cut(spots.where(F.col("leg") < F.size("stops") - 1).select("query", "leg", "source", F.element_at("stops", F.col("leg") + 2).alias("target")))
    legs = cut(wanted.select(F.col("source").alias("first"), F.col("target").alias("last")).distinct())
    ways = Grown(legs.select("last", F.col("last").alias("node"), F.lit(None).cast("string").alias("next")).distinct(), "ways")
    fresh, open_ = ways.all(), cut(legs.where("first <> last"))
    for _ in range(max_depth):
        fresh = fresh.join(open_.select("last").distinct(), "last", "left_semi")
        if fresh.isEmpty():
            break
        step = fresh.join(e, F.col("node") == F.col("target")).groupBy("last", F.col("source").alias("node")).agg(F.min("target").alias("next"))
        fresh = ways.add(step.join(ways.all().select("last", "node"), ["last", "node"], "left_anti"))
        open_ = cut(open_.join(fresh.select("last", F.col("node").alias("first")), ["last", "first"], "left_anti").select("first", "last"))
    ways = ways.all()
    walk = cut(legs.withColumns({"node": F.col("first"), "nodes": F.array("first")}))
    done = Grown(walk.where("node = last").select("first", "last", "nodes"), "legs-done")
    for _ in range(max_depth):
        walk = walk.where("node <> last").join(ways, ["last", "node"]).where("next is not null")
        walk = cut(walk.select("first", "last", F.col("next").alias("node"), F.concat("nodes", F.array("next")).alias("nodes")))
        if walk.isEmpty():
            break
        done.add(walk.where("node = last"))
    found = done.all().select(F.col("first").alias("source"), F.col("last").alias("target"), "nodes")
    by_leg = wanted.join(found, ["source", "target"], "left")
    own = F.when(F.col("leg") == 0, F.col("nodes")).otherwise(F.expr("slice(nodes, 2, greatest(size(nodes) - 1, 0))"))
    whole = by_leg.groupBy("query").agg(F.min(F.col("nodes").isNotNull()).alias("_all"), F.array_sort(F.collect_list(F.struct("leg", own.alias("own")))).alias("_legs"))  # an itinerary's own legs
    nodes = F.flatten(F.transform("_legs", lambda x: x["own"]))
    return whole.select("query", F.when(F.col("_all"), F.array_join(nodes, " > ")).alias("path"), F.when(F.col("_all"), F.size(nodes) - 1).alias("depth"))
