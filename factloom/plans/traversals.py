"""Paths, reachability, cycles and levels over edges (source, target), as joins that repeat until nothing is new."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.scratch import Grown, staged


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read again."""
    return staged(df, "traversal")


#: Edges that one task holds at once.
EDGES_A_TASK = 2_000_000


def _components(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes one node of its strong component (Tarjan's search, without recursion)."""
    order = np.argsort(source, kind="stable")
    heads = target[order].tolist()
    ends = np.searchsorted(source[order], np.arange(n), side="right").tolist()
    at = [0, *ends[:-1]]
    number, low, found = [0] * n, [0] * n, [-1] * n
    open_, count = [], 0
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        open_.append(root)
        way = [root]
        while way:
            v = way[-1]
            i = at[v]
            if i < ends[v]:
                at[v] = i + 1
                w = heads[i]
                if not number[w]:
                    count += 1
                    number[w] = low[w] = count
                    open_.append(w)
                    way.append(w)
                elif found[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            if low[v] == number[v]:
                while True:
                    w = open_.pop()
                    found[w] = v
                    if w == v:
                        break
    return np.array(found, np.int64)


def _searched(edges: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Names of nodes in order, sources and targets as places in them, and one node of each node's component."""
    both = pa.chunked_array([*edges.column("source").chunks, *edges.column("target").chunks])
    names = pc.unique(both)
    names = names.take(pc.sort_indices(names))
    source, target = (pc.index_in(edges.column(side), value_set=names).to_numpy().astype(np.int64) for side in ("source", "target"))
    return names, source, target, _components(len(names), source, target)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges that lead from and to the same nodes: a component's members go to one of them and back, and edges between components are one."""

    def thin(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        names, source, target, own = _searched(pa.Table.from_batches(held))
        n = len(names)
        members = np.flatnonzero(own != np.arange(n))
        alone = np.bincount(own, minlength=n) == 1
        kept = (own[source] != own[target]) | ((source == target) & alone[own[source]])
        between = np.unique(own[source[kept]] * n + own[target[kept]])
        out = (np.concatenate([own[members], members, between // n]), np.concatenate([members, own[members], between % n]))
        return pa.record_batch({side: names.take(pa.array(at)).cast(pa.string()) for side, at in zip(("source", "target"), out, strict=True)})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= EDGES_A_TASK:
            yield thin(held)
            held, size = [], 0
    if held:
        yield thin(held)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component (its least node) of components with two nodes or more, of all edges at once."""
    held = list(batches)
    if held:
        names, _, _, own = _searched(pa.Table.from_batches(held))
        least = np.full(len(names), len(names))
        np.minimum.at(least, own, np.arange(len(names)))
        big = np.flatnonzero(np.bincount(own, minlength=len(names))[own] > 1)
        yield pa.record_batch({"node": names.take(pa.array(big)).cast(pa.string()), "component": names.take(pa.array(least[own[big]])).cast(pa.string())})


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (source, target) by which the same nodes are reached from each node as by ``edges``, written.

    A task thins a bounded number of edges, which keeps what they reach and so what all of them reach together. What is left
    is thinned again while that halves it: a dense graph soon fits into one task, a sparse one stays as it is.
    """
    e = edges.select("source", "target").where("source is not null and target is not null")
    n = e.count()
    while True:
        tasks = -(-n // EDGES_A_TASK) or 1
        e = cut(e.repartition(tasks, "source", "target").mapInArrow(_thin, "source string, target string"))
        before, n = n, e.count()
        if tasks == 1 or 2 * n > before:
            return e


def reachable(edges: DataFrame) -> DataFrame:
    """source, target: every pair joined by a path of one edge or more.

    Edges are thinned and components contracted, and only their pairs are searched, semi-naive, and written; pairs of
    nodes are laid out when they are read. The result has a row for each pair of nodes, so it is for graphs of
    modules; ``reachable_from`` asks a large graph about some nodes.
    """
    e = thinned(edges)
    own = cut(components_of(e))
    loops = own.groupBy("component").count().where("count > 1").select("component").union(e.where("source = target").join(own, F.col("source") == F.col("node")).select("component")).distinct()
    between = component_pairs(condensed(e, own).select("source", "target"))
    every = between.union(loops.select("component", F.col("component").alias("other")))
    starts = every.join(own, "component").select(F.col("node").alias("source"), F.col("other").alias("component"))
    return laid_out(starts, own, "target")


def component_pairs(dag: DataFrame) -> DataFrame:
    """component, other: pairs joined by a path of edges (source, target) without cycles. Each round extends only what was new."""
    e = cut(dag)
    every = Grown(e.select(F.col("source").alias("component"), F.col("target").alias("other")), "reach")
    fresh = every.all()
    while not fresh.isEmpty():
        step = fresh.join(e, F.col("other") == F.col("source")).select("component", F.col("target").alias("other")).distinct()
        fresh = every.add(step.join(every.all(), ["component", "other"], "left_anti"))
    return every.all()


#: Members of a component are dealt into so many parts, so that pairs of a large one are laid out by many tasks.
MEMBER_PARTS = 256


def laid_out(starts: DataFrame, own: DataFrame, name: str) -> DataFrame:
    """``starts`` (with component) with each member of their component as ``name``; ``own``: node, component. Nothing but both sides is shuffled."""
    sizes = own.groupBy("component").agg(F.least(F.count("*"), F.lit(MEMBER_PARTS)).alias("_parts"))
    members = own.join(sizes, "component").select("component", F.col("node").alias(name), F.pmod(F.xxhash64("node"), F.col("_parts")).alias("_part"))
    asked = starts.join(sizes, "component").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return asked.repartition(MEMBER_PARTS, "component", "_part").join(members.repartition(MEMBER_PARTS, "component", "_part").hint("merge"), ["component", "_part"]).select(*(c for c in starts.columns if c != "component"), name)


def reachable_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, hops: the nodes that can be reached from any of ``starts`` (node), with the least number of edges."""
    e = cut(edges.select("source", "target").distinct())
    seen = Grown(starts.select("node").distinct().withColumn("hops", F.lit(0)), "seen")
    fresh, hops = seen.all(), 0
    while not fresh.isEmpty():
        hops += 1
        step = fresh.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        fresh = seen.add(step.join(seen.all(), "node", "left_anti").withColumn("hops", F.lit(hops)))
    return seen.all()


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of strongly connected components with two nodes or more.

    Nodes without an edge in or out are pruned round by round. Then colours: each node takes the
    least node that reaches it; within a colour, what reaches the colour's own node is its
    component. Found ones leave and the rest goes on. This is for graphs that, thinned, are more than
    one task can hold; else one task searches what is left.
    """
    spark = edges.sparkSession
    found = spark.createDataFrame([], "node string, component string")
    e = thinned(edges.where("source <> target"))
    if e.count() <= EDGES_A_TASK:
        return cut(e.coalesce(1).mapInArrow(_labelled, "node string, component string"))
    while not e.isEmpty():
        n = -1
        while (now := e.count()) != n:
            n = now
            e = cut(e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if not n:
            break
        colour = cut(e.select(F.col("source").alias("node")).union(e.select(F.col("target").alias("node"))).distinct().withColumn("colour", F.col("node")))
        while True:
            came = e.join(colour, F.col("source") == F.col("node")).groupBy("target").agg(F.min("colour").alias("c"))
            after = cut(colour.join(came, F.col("node") == F.col("target"), "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("moved")))
            moved = after.where("moved").isEmpty()
            colour = after.select("node", "colour")
            if moved:
                break
        inside = e.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("ct")), "target").where("cs = ct").select("source", "target", F.col("cs").alias("colour"))
        inside = cut(inside)
        parts = Grown(colour.where("node = colour"), "component")
        fresh = parts.all()
        while not fresh.isEmpty():
            back = inside.join(fresh.select(F.col("node").alias("target")), "target").select(F.col("source").alias("node"), "colour").distinct()
            fresh = parts.add(back.join(parts.all(), ["node", "colour"], "left_anti"))
        own = parts.all()
        big = own.groupBy("colour").count().where("count > 1").select("colour")
        found = cut(found.union(own.join(big, "colour").select("node", F.col("colour").alias("component"))))
        left = own.select("node")
        e = cut(e.join(left.select(F.col("node").alias("source")), "source", "left_anti").join(left.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"))
    return found


def components_of(edges: DataFrame) -> DataFrame:
    """node, component of every node of ``edges``: strongly connected nodes have their least one, the others are their own."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return nodes.join(strong_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensed(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """source, target, links: each component is one node; edges between two components are one, with their number. Never a cycle.

    ``members``: node, component, if known already.
    """
    own = components_of(edges) if members is None else members
    s, t = own.select(F.col("node").alias("source"), F.col("component").alias("_s")), own.select(F.col("node").alias("target"), F.col("component").alias("_t"))
    e = edges.select("source", "target").distinct().join(s, "source").join(t, "target").where("_s <> _t")
    return e.groupBy(F.col("_s").alias("source"), F.col("_t").alias("target")).agg(F.count("*").alias("links"))


def event_cycles(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """component, nodes, services, topics of cycles through three nodes, two services and a topic at least. ``kinds``: node, kind."""
    c = strong_components(edges).join(kinds.select("node", "kind").distinct(), "node")
    t = c.groupBy("component").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("kind") == "service", 1)).alias("services"), F.count(F.when(F.col("kind") == "topic", 1)).alias("topics"))
    return t.where("nodes >= 3 and services >= 2 and topics >= 1")


def shortest_paths(edges: DataFrame, source: str, target: str, *, max_depth: int = 12, limit: int = 20) -> DataFrame:
    """depth, path (nodes joined by ' > ') of all shortest simple paths, in order of their steps; at most ``limit``, with ``truncated``.

    Edges (source, target and, if parallel ones are to count, id) are followed level by level and only
    from nodes not met before, until the target's level is known. Then levels keep what leads to the
    target, and paths are laid forward over them, of each level the first ``limit`` and one more: all of
    them lead to the target. With id, parallel edges give paths of their own, and ``relations`` has the
    ids joined by ' > '.
    """
    ids = [c for c in edges.columns if c == "id"]
    e = cut(edges.select("source", "target", *ids).distinct())
    spark: SparkSession = edges.sparkSession
    start = spark.createDataFrame([(source,)], "node string")
    levels, seen = [start], Grown(start, "seen")
    hit = source == target
    while not hit and len(levels) <= max_depth:
        step = levels[-1].join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        step = seen.add(step.join(seen.all(), "node", "left_anti"))
        if step.isEmpty():
            break
        levels.append(step)
        hit = not step.where(F.col("node") == target).isEmpty()
    order = ["path", *(["relations"] if ids else [])]
    if not hit:
        return spark.createDataFrame([], "depth int, " + "".join(f"{c} string, " for c in order) + "truncated boolean")
    keeps = [spark.createDataFrame([(target,)], "node string")]
    for level in reversed(levels[1:-1]):
        back = e.join(keeps[-1], F.col("target") == F.col("node"), "left_semi").select(F.col("source").alias("node"))
        keeps.append(cut(level.join(back.distinct(), "node", "left_semi")))
    paths = spark.createDataFrame([([source],)], "steps array<string>")
    own = F.col("id").cast("string") if ids else F.lit("")
    for keep in reversed(keeps[: len(levels) - 1]):
        at = F.col("steps")[0] if keep is keeps[-1] or len(levels) == 2 else F.element_at("steps", -2)
        e_here = e.join(keep, F.col("target") == F.col("node"), "left_semi")
        paths = paths.join(e_here, at == F.col("source")).select(F.concat("steps", F.array("target", own)).alias("steps"))
        paths = cut(paths.orderBy("steps").limit(limit + 1))
    more = paths.count() > limit
    odd = lambda start: F.filter("steps", lambda x, i: (i > 0) & (i % 2 == start))
    paths = paths.orderBy("steps").limit(limit)
    shown = paths.select(F.lit(len(levels) - 1).alias("depth"), F.array_join(F.concat(F.slice("steps", 1, 1), odd(1)), " > ").alias("path"), F.array_join(odd(0), " > ").alias("relations"), F.lit(more).alias("truncated"))
    return shown.select("depth", *order, "truncated")


def first_paths(start: DataFrame, extend: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], max_depth: int, limit: int) -> tuple[DataFrame, bool]:
    """The first ``limit`` endings (nodes, ending) in lexical order of a search over paths (nodes), and whether there are more.

    ``extend`` takes the live paths of a depth and gives endings and longer live paths, which begin
    with what they extend. Of each depth the first paths go on, and the first one left out is
    remembered: all endings before it are complete. If these are too few, the search is repeated with
    more paths, so nothing is lost.
    """
    width = 8 * limit
    while True:
        live, done, left_out = start, None, None
        for depth in range(1, max_depth + 1):
            ends, longer = extend(live, depth)
            found = ends.select("nodes", "ending")
            done = cut((found if done is None else done.union(found)).distinct().orderBy("nodes").limit(limit + 1))
            if depth == max_depth:
                break
            live = cut(longer.select("nodes").distinct().orderBy("nodes").limit(width + 1))
            if live.count() > width:
                last = live.agg(F.max("nodes")).first()[0]
                left_out = last if left_out is None else min(left_out, last)
                live = live.where(F.col("nodes") < F.lit(last))
        if left_out is not None and done.where(F.col("nodes") < F.lit(left_out)).count() <= limit:
            width *= 8
            continue
        return done.orderBy("nodes").limit(limit), done.count() > limit


def flows(publishes: DataFrame, consumes: DataFrame, start: str, *, max_depth: int = 6, limit: int = 50) -> DataFrame:
    """path, ending, truncated: from a topic to its consumers, to the topics they publish, and so on.

    A path ends at a consumer that publishes nothing (leaf) or at ``max_depth`` topics (depth), or at a
    topic that it has met (cycle). Topics without a consumer end nothing and give no path. Paths come in
    lexical order of their nodes, ``limit`` at most. ``publishes`` and ``consumes`` have module, topic.
    """
    hop = cut(consumes.select(F.col("topic").alias("_t"), "module").distinct())
    out = cut(publishes.select(F.col("module").alias("_m"), F.col("topic").alias("next")).distinct())
    writes = out.select("_m").distinct().withColumn("_w", F.lit(True))

    def extend(live: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        at = live.join(hop, F.element_at("nodes", -1) == F.col("_t")).join(writes, F.col("module") == F.col("_m"), "left").select(F.concat("nodes", F.array("module")).alias("nodes"), "module", "_w")
        stop = at if depth == max_depth else at.where("_w is null")
        ends = stop.select("nodes", F.when(F.col("_w").isNull(), "leaf").otherwise("depth").alias("ending"))
        if depth == max_depth:
            return ends, live
        via = at.where("_w").join(out, F.col("module") == F.col("_m"))
        longer = via.select(F.concat("nodes", F.array("next")).alias("nodes"), F.array_contains("nodes", F.col("next")).alias("met"))
        return ends.union(longer.where("met").select("nodes", F.lit("cycle"))), longer.where("not met")

    spark = publishes.sparkSession
    found, more = first_paths(spark.createDataFrame([([start],)], "nodes array<string>"), extend, max_depth, limit)
    return found.select(F.array_join("nodes", " > ").alias("path"), "ending", F.lit(more).alias("truncated"))


def simple_paths(edges: DataFrame, source: str, target: str, *, max_depth: int = 8, limit: int = 8) -> DataFrame:
    """path, depth, truncated of the first simple paths from ``source`` to ``target``, in lexical order; ``max_depth`` edges at most.

    Only edges whose target leads to ``target`` in the edges that are left are followed.
    """
    spark = edges.sparkSession
    e = cut(edges.select("source", "target").where("source <> target").distinct())
    back = cut(reachable_from(e.select(F.col("target").alias("source"), F.col("source").alias("target")), spark.createDataFrame([(target,)], "node string")).where(F.col("hops") <= max_depth))
    e = cut(e.join(back, F.col("target") == F.col("node")).select("source", "target", "hops"))

    def extend(live: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        longer = live.join(e, F.element_at("nodes", -1) == F.col("source")).where((F.col("hops") <= max_depth - depth) & ~F.array_contains("nodes", F.col("target")))
        longer = longer.select(F.concat("nodes", F.array("target")).alias("nodes"), (F.col("target") == target).alias("hit"))
        return longer.where("hit").select("nodes", F.lit("target").alias("ending")), longer.where("not hit")

    found, more = first_paths(spark.createDataFrame([([source],)], "nodes array<string>"), extend, max_depth, limit)
    return found.select(F.array_join("nodes", " > ").alias("path"), (F.size("nodes") - 1).alias("depth"), F.lit(more).alias("truncated"))


def itinerary(edges: DataFrame, query: str, *, max_depth: int = 12) -> DataFrame:
    """leg, path, depth: the first shortest path of each leg of a query ``a -> b -> c``; an unreachable leg has none."""
    stops = [x.strip() for x in query.split("->") if x.strip()]
    spark = edges.sparkSession
    out = spark.createDataFrame([], "leg int, path string, depth int")
    for k, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
        leg = shortest_paths(edges.select("source", "target"), a, b, max_depth=max_depth, limit=1)
        out = out.union(leg.select(F.lit(k + 1).alias("leg"), "path", "depth"))
    return out


def levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest path from a node without edges in; nodes on or behind cycles share the level after the last."""
    e = cut(edges.select("source", "target").where("source <> target").distinct())
    left = cut(e.select(F.col("source").alias("node")).union(e.select(F.col("target").alias("node"))).distinct())
    placed = Grown(edges.sparkSession.createDataFrame([], "node string, level int"), "levels")
    rest, k = e, 0
    while not left.isEmpty():
        free = cut(left.join(rest.select(F.col("target").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            placed.add(left.withColumn("level", F.lit(k)))
            break
        placed.add(free.withColumn("level", F.lit(k)))
        left = cut(left.join(free, "node", "left_anti"))
        rest = cut(rest.join(free.select(F.col("node").alias("source")), "source", "left_anti").select("source", "target"))
        k += 1
    return placed.all()
