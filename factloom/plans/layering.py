"""Graphs without their cycles: contraction of components, order inside levels, and labels that answer reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.traversals import components_of, condensed, cut, levels
from factloom.scratch import Grown


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each one in a stated total order.

    Rows are dealt in ranges of that order; each range sums its own rows and the ranges' totals, a row
    each, say where it begins, so no task holds all rows.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_value": value}))
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_total"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(ahead.orderBy("_range")), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum("_value").over(ahead.partitionBy("_range").orderBy(*order)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_range", "_value", "_own", "_start")  # a row a partition


def component_levels(edges: DataFrame) -> DataFrame:
    """component, members, level: of each component its size and the longest way to it from one without edges in."""
    own = cut(components_of(edges))
    sizes = own.groupBy("component").agg(F.count("*").alias("members"))
    placed = levels(condensed(edges, own).select("source", "target")).select(F.col("node").alias("component"), "level")
    return sizes.join(placed, "component", "left").select("component", "members", F.coalesce("level", F.lit(0)).alias("level"))


def ordered_levels(edges: DataFrame, placed: DataFrame | None = None, *, sweeps: int = 1) -> DataFrame:
    """node, level, place, x: nodes of a level in the order of the mean place of those with an edge to them, then of their names.

    At first a node's place is its rank by name among all nodes. A sweep goes through the levels from the
    top and gives each level's nodes their places in it, which later levels see; nodes without edges in
    count as 0. ``x`` centres each level on the widest one. ``placed``: node, level.
    """
    e = cut(edges.select("source", "target").distinct())
    at = cut(levels(e) if placed is None else placed.select("node", "level"))
    order = running(at, [F.col("node")], F.lit(1), "place")
    widths = at.groupBy("level").agg(F.count("*").alias("n"))
    deepest = at.agg(F.max("level")).first()[0]
    for _ in range(sweeps):
        order = cut(order.select("node", "level", "place"))
        for level in range((-1 if deepest is None else deepest) + 1):
            here = order.where(F.col("level") == level)
            came = e.join(here.select(F.col("node").alias("target")), "target").join(order.select(F.col("node").alias("source"), "place"), "source")
            mean = came.groupBy(F.col("target").alias("node")).agg((F.sum("place").cast("double") / F.count("*")).alias("mean"))
            new = here.select("node", "level").join(mean, "node", "left").na.fill(0.0, ["mean"])
            new = running(new, [F.col("mean"), F.col("node")], F.lit(1), "place")
            order = cut(order.where(F.col("level") != level).unionByName(new.select("node", "level", "place")))
    widest = widths.agg(F.max("n").alias("widest"))
    shown = order.join(widths, "level").crossJoin(widest)  # one row
    return shown.select("node", "level", F.col("place").cast("int").alias("place"), ((F.col("widest") - F.col("n")) * 0.5 + F.col("place")).alias("x"))


def reachability_labels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, number; node, low, high): nodes can be reached from a node where its intervals hold their numbers.

    Components get one number. Over the condensed graph each component hangs below one of those before it
    (the deepest, then the least), which gives a tree; numbers are its preorder, so a subtree is one
    interval. From the deepest level up a component takes over the intervals of all its targets, less
    those that others hold: tree edges add none, the exceptions do. A few joins a level, and no pairs.
    """
    own = cut(components_of(edges))
    dag = cut(condensed(edges, own).select("source", "target"))
    place = levels(dag).select(F.col("node").alias("component"), "level")
    place = cut(own.select("component").distinct().join(place, "component", "left").select("component", F.coalesce("level", F.lit(0)).alias("level")))
    deepest = place.agg(F.max("level")).first()[0]
    if deepest is None:
        nothing = own.select("node", F.lit(0).cast("long").alias("number"))
        return nothing, nothing.select("node", F.col("number").alias("low"), F.col("number").alias("high"))
    before = dag.join(place.select(F.col("component").alias("source"), "level"), "source")
    parent = cut(before.groupBy("target").agg(F.max_by("source", F.struct("level", "source")).alias("parent")).select(F.col("target").alias("component"), "parent"))
    sizes = Grown(place.where(F.col("level") == deepest).select("component", F.lit(1).cast("long").alias("size")), "sizes")
    for level in range(deepest - 1, -1, -1):
        below = sizes.all().join(parent, "component").groupBy(F.col("parent").alias("component")).agg(F.sum("size").alias("below"))
        sizes.add(place.where(F.col("level") == level).join(below, "component", "left").select("component", (1 + F.coalesce("below", F.lit(0))).alias("size")))
    size = sizes.all()
    tops = running(place.join(parent, "component", "left_anti").join(size, "component").select("component", "size"), [F.col("component")], F.col("size"), "number")
    kids = parent.join(size, "component")
    ahead = Window.partitionBy("parent").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    kids = cut(kids.withColumn("skip", F.coalesce(F.sum("size").over(ahead), F.lit(0))))
    numbers = Grown(tops.select("component", "size", "number"), "numbers")
    fresh = numbers.all()
    while not fresh.isEmpty():
        fresh = numbers.add(kids.join(fresh.select(F.col("component").alias("parent"), F.col("number").alias("_n")), "parent").select("component", "size", (F.col("_n") + 1 + F.col("skip")).alias("number")))
    numbered = numbers.all()
    tree = numbered.select("component", F.col("number").alias("low"), (F.col("number") + F.col("size") - 1).alias("high"))
    spans = Grown(tree.join(place.where(F.col("level") == deepest), "component").select("component", "low", "high"), "spans")
    for level in range(deepest - 1, -1, -1):
        here = place.where(F.col("level") == level).select("component")
        taken = dag.join(here.select(F.col("component").alias("source")), "source").join(spans.all(), F.col("target") == F.col("component")).select(F.col("source").alias("component"), "low", "high")
        mine = tree.join(here, "component").unionByName(taken).groupBy("component", "low").agg(F.max("high").alias("high"))
        held = F.max("high").over(Window.partitionBy("component").orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
        spans.add(mine.withColumn("_held", held).where("_held is null or _held < high").select("component", "low", "high"))
    return own.join(numbered.select("component", "number"), "component").select("node", "number"), own.join(spans.all(), "component").select("node", "low", "high")


def reaches(pairs: DataFrame, numbers: DataFrame, intervals: DataFrame) -> DataFrame:
    """source, target, reached of asked pairs (source, target), from ``reachability_labels``; a known node reaches itself, an unknown one nothing."""
    asked = pairs.select("source", "target").distinct()
    found = asked.join(numbers.select(F.col("node").alias("target"), "number"), "target").join(intervals.select(F.col("node").alias("source"), "low", "high"), "source").where(F.col("number").between(F.col("low"), F.col("high")))
    return asked.join(found.select("source", "target").distinct().withColumn("reached", F.lit(True)), ["source", "target"], "left").na.fill(False, ["reached"])


def reached(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, reached of asked pairs (source, target) over any edges, with the rows of ``reaches`` on their labels, but without labels.

    Asked targets are numbered in blocks of 64, and a node has a mask of the targets of a block that it leads
    to. Masks go backwards over the edges, and a round passes on only bits that are new at a node, so a
    round moves at most a row for each edge and block, however many paths there are. The side of the pairs with
    fewer different nodes is taken for targets. Where both sides are about all nodes, masks are a 64th of all pairs.
    """
    asked = cut(pairs.select("source", "target").distinct())
    e = cut(edges.select("source", "target").distinct())
    sides = asked.agg(F.count_distinct("source").alias("s"), F.count_distinct("target").alias("t")).first()
    near, far = ("source", "target") if sides["t"] <= sides["s"] else ("target", "source")
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    wanted = asked.select(F.col(far).alias("node")).distinct().join(nodes, "node", "left_semi")
    numbered = cut(running(wanted, [F.col("node")], F.lit(1), "number").select("node", F.floor(F.col("number") / 64).alias("block"), F.expr("shiftleft(1L, cast(number % 64 as int))").alias("mask")))
    masks = Grown(numbered, "masks")
    fresh = masks.all()
    while not fresh.isEmpty():
        step = fresh.join(e.select(F.col(near).alias("_to"), F.col(far).alias("node")), "node").groupBy(F.col("_to").alias("node"), "block").agg(F.bit_or("mask").alias("mask"))
        known = masks.all().groupBy("node", "block").agg(F.bit_or("mask").alias("_known"))
        new = step.join(known, ["node", "block"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long")))))
        fresh = masks.add(new.where("mask <> 0"))
    held = masks.all().groupBy(F.col("node").alias(near), "block").agg(F.bit_or("mask").alias("_held"))
    found = asked.join(numbered.select(F.col("node").alias(far), "block", F.col("mask").alias("_bit")), far, "left").join(held, [near, "block"], "left")
    return found.select("source", "target", F.coalesce(F.col("_held").bitwiseAND(F.col("_bit")) != 0, F.lit(False)).alias("reached"))
