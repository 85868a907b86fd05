"""Identities of facts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def endpoint_id(role: Column, topic: Column, path: Column, start: Column, end: Column) -> Column:
    """Role, topic, path and lines; lines are left out without a start, the end falls back to the start."""
    where = F.when(start.isNull(), F.lit("")).otherwise(F.concat(F.lit("|"), start.cast("string"), F.lit(":"), F.coalesce(end, start).cast("string")))
    return short_sha(F.concat(role, F.lit("|"), topic, F.lit("|"), path, where))


def relation_id(source_kind: Column, source: Column, relation: Column, target_kind: Column, target: Column, path: Column, start: Column) -> Column:
    where = F.when(path.isNull() | start.isNull(), F.lit("")).otherwise(F.concat(F.lit("|"), path, F.lit(":"), start.cast("string")))
    return short_sha(F.concat(source_kind, F.lit("|"), source, F.lit("|"), relation, F.lit("|"), target_kind, F.lit("|"), target, where))


def fact_id(*parts: Column) -> Column:
    """Of a fact entered by hand: all parts, null as the empty text."""
    joined = [x for p in parts for x in (F.lit("|"), F.coalesce(p, F.lit("")))][1:]
    return F.sha2(F.concat(*joined), 256)


def imported_id(namespace: Column, kind: Column, raw: Column) -> Column:
    return F.concat(namespace, F.lit("::"), kind, F.lit("::"), raw)
