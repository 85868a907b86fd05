"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import staged


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, most: int, columns: dict[str, Column], *, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """(labelled documents outside the held-out fold: _id, y and the named columns of ``docs``; the weight of a row of each class).

    They are of at most ``most`` ids, and of so many wherever as many have a label and a document.
    Each class has half of the places and those that the other
    leaves free; within a class the ids' hashes decide. Weights give the classes the shares that they have among labelled documents
    again, so a bound that is reached moves no scores. An id with several labels counts as its
    largest one; labels without a document take no place, nor do rows without an id or a label.
    Documents that repeat an id are all in the result: ``one_each`` keeps one of them. The sample has ``most`` ids at most, so it is
    broadcast to ``docs``.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("_id"), mod) != held_out))
    here = docs.select(F.col(id_col).cast("long").alias("_id")).distinct()
    ids = staged(ids.groupBy("_id").agg((F.max("y") > 0).cast("int").alias("y")).join(here, "_id", "left_semi"), "labelled-ids")
    counts = {int(r[0]): int(r[1]) for r in ids.groupBy("y").count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    take_ones = min(ones, max(most // 2, most - zeros))
    take_zeros = min(zeros, most - take_ones)
    order = F.xxhash64("_id")
    one, zero = (ids.where(F.col("y") == y).orderBy(order, "_id").limit(n) for y, n in ((1, take_ones), (0, take_zeros)))
    picked = one.unionByName(zero)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), *(c.alias(name) for name, c in columns.items()))
    share = (take_ones + take_zeros) / max(1, ones + zeros)
    weights = {1: ones / max(1, take_ones) * share, 0: zeros / max(1, take_zeros) * share}
    return rows.join(F.broadcast(picked), "_id"), weights


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each id, that of the least other columns: rows that repeat an id are partially aggregated before they are sent."""
    rest = [c for c in rows.columns if c != "_id"]
    return rows.groupBy("_id").agg(F.min(F.struct(*rest)).alias("_row")).select("_id", *(F.col(f"_row.{c}").alias(c) for c in rest))
