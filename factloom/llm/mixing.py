"""Mixing sources to target weights by hash thresholds.

A document's hash is the first 60 bits of md5(seed, id). Each source takes whole passes over
itself and, of one more pass, the documents whose hash lies under a threshold. The threshold is
found by histograms: words are summed by source and hash bucket, the bucket in which the budget
ends is refined by the next bits, and so on; nothing is sorted but bucket sums.

Rows that share the boundary hash (one id, or none) are told apart in the same way by a second hash,
of their text; rows that share both count as equal, and as many of them are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import staged

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
BITS = 12


def hash60(*cols: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """source, source_size, target: the budget by weight, none above ``most`` times its source, the excess reshared.

    In order of (cap / weight), the first k sources are full and the rest share what is left by
    weight; k is the least with which none of the rest is above its cap. One row for each source.
    """
    whole = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    t = sizes.withColumn("_w", F.element_at(kinds, ((F.row_number().over(whole) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"_budget": F.sum("source_size").over(every) * F.lit(float(share)), "_full": F.coalesce(F.sum("_cap").over(order), F.lit(0.0)), "_left": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(order), F.lit(0.0))})
    t = t.withColumn("_rate", (F.col("_budget") - F.col("_full")) / F.col("_left"))
    t = t.withColumn("_fits", F.when(F.col("_rate") * F.col("_w") <= F.col("_cap"), F.col("_rate")))
    t = t.withColumn("_rate", F.max("_fits").over(every))
    return t.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_rate") * F.col("_w"), F.col("_cap"))).alias("target"))


def refined(rows: DataFrame, low: DataFrame, column: str) -> DataFrame:
    """source, value, need, mass, rows: the value of a 60-bit ``column`` at which each source's words run out.

    ``rows`` has source, size and ``column``; ``low`` source and need. ``need`` is what is left to take
    of the ``mass`` of words (of so many rows) with that value. Sources that are taken whole have no row. A level reads the boundary
    buckets' rows and sums at most 4,096 buckets for each source.
    """
    low = low.select("source", F.lit(0).cast("long").alias("_prefix"), F.col("need").alias("_need"))
    for level in range(HASH_BITS // BITS):
        shift = HASH_BITS - BITS * (level + 1)
        left = F.shiftright(F.col(column), shift + BITS)
        inside = rows.join(low, rows["source"].eqNullSafe(low["source"])).where(left == F.col("_prefix")).select(rows["source"].alias("source"), F.shiftright(rows[column], shift).alias("_bucket"), "size")
        sums = inside.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"), F.count("*").alias("_rows"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        run = sums.withColumn("_before", before).join(low.select(F.col("source").alias("_s"), "_need"), F.col("source").eqNullSafe(F.col("_s")))
        edge = run.where((F.col("_before") <= F.col("_need")) & (F.col("_before") + F.col("_n") > F.col("_need")))
        low = staged(edge.groupBy("source").agg(F.max(F.struct("_bucket", "_before", "_need", "_n", "_rows")).alias("e")).select("source", F.col("e._bucket").alias("_prefix"), (F.col("e._need") - F.col("e._before")).alias("_need"), F.col("e._n").alias("_n"), F.col("e._rows").alias("_rows")), "mix-edge")
    return low.select("source", F.col("_prefix").alias("value"), F.col("_need").alias("need"), F.col("_n").alias("mass"), F.col("_rows").alias("rows"))


def sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Columns doc_id, source, size, hash, tie of documents."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORDS)).cast("long")
    return [doc_id.alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), hash60(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).alias("hash"), hash60(text).alias("tie")]


def mix_plan(base: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """_source, source_size, target, passes, edge, tie_edge, equal_rows, equal_taken: a row for each source. ``base`` is a written table (source, hash, tie, size)."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, share, weights, most), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets.select("source", (F.col("target") - passes * F.col("source_size")).alias("need")).where(F.col("need") > 0)
    edges = staged(refined(base.select("source", "hash", "size"), budgets, "hash"), "mix-edges")
    on_edge = base.join(edges.select(F.col("source").alias("_s"), F.col("value").alias("_edge")), F.col("source").eqNullSafe(F.col("_s"))).where(F.col("hash") == F.col("_edge"))
    if edges.where("rows > 1").isEmpty():
        ties = on_edge.join(edges.select(F.col("source").alias("_t"), "need", "mass", "rows"), F.col("source").eqNullSafe(F.col("_t"))).select("source", F.col("tie").alias("value"), "need", "mass", "rows")
    else:
        ties = refined(staged(on_edge.select("source", "tie", "size"), "mix-ties"), edges.select("source", "need"), "tie")
    one = F.col("mass") / F.col("rows")
    whole = F.floor(F.col("need") / one)
    rest = F.col("need") - whole * one
    taken = (whole + F.when(one - rest <= rest, 1).otherwise(0)).cast("long")
    edges = edges.select(F.col("source").alias("_s"), F.col("value").alias("edge"))
    ties = ties.select(F.col("source").alias("_t"), F.col("value").alias("tie_edge"), F.col("rows").alias("equal_rows"), taken.alias("equal_taken"))
    plan = targets.join(edges, F.col("source").eqNullSafe(F.col("_s")), "left").join(ties, F.col("source").eqNullSafe(F.col("_t")), "left")
    return staged(plan.select(F.col("source").alias("_source"), "source_size", "target", passes.alias("passes"), "edge", "tie_edge", "equal_rows", "equal_taken"), "mix-plan")


def planned(base: DataFrame, plan: DataFrame) -> DataFrame:
    """``base`` (a written table with a column ``part`` that deals it) with its plan and ``times``: how often a row is taken.

    Of several equal rows at the boundary the first ones are taken: they are counted by part, and
    numbered within a part, so no task meets all of them.
    """
    joined = base.join(plan, base["source"].eqNullSafe(plan["_source"]))
    order = F.when(F.col("edge").isNull(), F.lit(0)).when(F.col("hash") != F.col("edge"), (F.col("hash") < F.col("edge")).cast("int")).when(F.col("tie") != F.col("tie_edge"), (F.col("tie") < F.col("tie_edge")).cast("int"))
    some = plan.where("equal_rows > 1")
    if some.isEmpty():
        more = F.coalesce(order, F.col("equal_taken"))
        return joined.withColumn("times", F.col("passes") + more)
    equal = joined.where(order.isNull())
    parts = equal.groupBy("_source", "part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_source").alias("_ps"), F.col("part").alias("_pp"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    numbered = equal.withColumn("_at", F.row_number().over(Window.partitionBy("_source", "part").orderBy("tie")))
    numbered = numbered.join(parts, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("part") == F.col("_pp")))
    names = joined.columns
    numbered = numbered.select(*names, (F.col("passes") + (F.col("_before") + F.col("_at") <= F.col("equal_taken")).cast("int")).alias("times"))
    return joined.where(order.isNotNull()).withColumn("times", F.col("passes") + order).unionByName(numbered)


PART_ROWS = 1 << 20


def part_of_row() -> Column:
    """Runs of at most ``PART_ROWS`` rows of a task."""
    return F.shiftright(F.monotonically_increasing_id(), PART_ROWS.bit_length() - 1)


def mix_sources(docs: DataFrame, *, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    A null text has size 0; null is a source of its own, after the others. Rows of one id, or
    without one, follow each other by their texts' hashes; of rows with one id and one text any are
    taken, as many as come nearest to the target. Sizes of 0 take nothing; very long texts are counted whole. An
    empty table gives an empty result. Other columns are ignored. The word counts are staged
    once; later passes read only hashes and sizes. Sources are few: their totals are one window, and 4,096 bucket sums of a source another.
    """
    base = staged(docs.select(*sized(docs, seed, id_col, text_col, source_col)).withColumn("part", part_of_row()), "mix-sizes")
    plan = mix_plan(base, share, weights, most)
    return planned(base, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken.

    The same documents as ``mix_sources`` takes. Where several rows have the boundary's id and text,
    a row's number among them is looked up by its place in the scan, so ``docs`` should be a written table.
    """
    own = sized(docs, seed, id_col, text_col, source_col)
    base = staged(docs.select(*own[1:]).withColumn("part", part_of_row()), "mix-sizes")
    plan = mix_plan(base, share, weights, most)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *own[1:]).withColumn("part", part_of_row())
    out = planned(rows, plan).where("times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_turn")).select("_row.*")


ORACLE_SQL = r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as hash,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as tie
  from documents),
src as (select source, sum(size)::bigint as source_size from base group by source),
w as (select *, case (row_number() over (order by source is null, encode(source)) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, source_size * 2.0::double as cap from src),
run as (select *, sum(source_size) over () * 1.5::double as budget,
          coalesce(sum(cap) over (order by cap / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0.0::double) as full_,
          sum(w) over () - coalesce(sum(w) over (order by cap / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0.0::double) as left_ from w),
rate as (select *, max(case when (budget - full_) / left_ * w <= cap then (budget - full_) / left_ end) over () as rate from run),
target as (select source, source_size, least(cap, coalesce(rate * w, cap)) as target from rate),
pass as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from target),
cum as (select b.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size as rest,
          coalesce(sum(b.size) over (partition by b.source order by b.hash, b.tie rows between unbounded preceding and 1 preceding), 0) as before_
        from base b join pass p on b.source is not distinct from p.source)
select doc_id, size, source_size, target,
       (size * (passes + case when rest > 0 and (before_ + size <= rest or (before_ <= rest and before_ + size - rest <= rest - before_)) then 1 else 0 end))::bigint as taken
from cum
"""
