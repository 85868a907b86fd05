"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, staged


def components(edges: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (columns a, b).

    Each round hangs every node's larger neighbours on its least one, then its smaller ones. Minima
    are partially aggregated and neighbours are joined, never gathered, so that a node with very
    many edges is one key of a join and not a group in a task. Nulls are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    e = staged(e, "edges")
    last = None
    for _ in range(most_rounds):
        both = e.where("a > b").select("a", "b").union(e.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.distinct(), "edges")
        discard(e)
        small_least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = large.join(small_least, large["a"] == small_least["u"]).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(moved.union(small_least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a > b").distinct(), "edges")
        discard(large)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return staged(e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots).union(edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("label"))).groupBy("node").agg(F.min("label").alias("label")), "components")
