"""Exact k-means over integer vectors by an incremental distance matrix.

Every vector keeps its integer dot products with all centroids in a written table. A round adds
to them only what the nonzero component changes of each centroid contribute, picks the nearest
centroid by ``|c|^2 - 2 x.c`` anew, and sums each cluster's vectors for the next centroids. All of
it is integer arithmetic, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, staged

SCALE = 1024
#: Components beyond it could take a squared distance of 64 of them out of 64 bits; they are refused.
MOST = 1 << 27
SCHEMA = "vec_id bigint, x array<int>, dots array<bigint>, cluster int, distance bigint"


def integer_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: floor(1024 * component) of the vectors with exactly ``dims`` components, none null or non-finite."""
    v = F.col(vector_col)
    kept = vectors.where((F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))

    def whole(c: Column) -> Column:
        big = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(big) <= MOST, big).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST // SCALE} and its distances beyond 64 bits"))).cast("int")

    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("x"))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """A list column without nulls as rows of ``n`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1), kind))


def assigned(changes: np.ndarray, norms: np.ndarray):
    """A mapper that adds each centroid's nonzero component ``changes`` to the dot products and recomputes cluster and distance."""
    k, dims = changes.shape
    moved = [(j, np.flatnonzero(row), row[np.flatnonzero(row)]) for j, row in enumerate(changes) if row.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dots = matrix(batch.column("x"), dims), matrix(batch.column("dots"), k)
            for j, at, by in moved:
                dots[:, j] += x[:, at] @ by
            partial = norms - 2 * dots
            cluster = partial.argmin(axis=1)  # the first of equal ones
            distance = partial[np.arange(len(x)), cluster] + (x * x).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), listed(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "x", "dots", "cluster", "distance"])

    return run


def summed(k: int, dims: int):
    """A mapper to cluster, n, sums: one row for each cluster and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, x = batch.column("cluster").to_numpy(), matrix(batch.column("x"), dims)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums = np.add.reduceat(x[order], first, axis=0) if len(found) else np.zeros((0, dims), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.diff([*first, len(cluster)]), pa.int64()), listed(sums, pa.int64())], names=["cluster", "n", "sums"])

    return run


def floored_means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floored means of their vectors; empty clusters keep theirs."""
    k, dims = centroids.shape
    parts = rows.select("cluster", "x").mapInArrow(summed(k, dims), "cluster int, n bigint, sums array<bigint>")
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums")).collect():  # k rows
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def clustered(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, dots, cluster, distance of every kept vector, as a written table; the final centroids).

    Vectors that are null, of another length, or that hold null or non-finite components take no
    part. Centroids start as the ``k`` vectors with the least sha256 of seed and id; a null id is the
    empty text there, equal ids go by their components, and with fewer than ``k`` vectors there are
    as many centroids. Equal rows stay, each with its own result. A round that moves no centroid ends
    the rounds, as all later ones would be the same. Components beyond 2^17 in size are an error. Only
    ``k`` centroids and their sums reach the driver; a round writes its table and deletes the last one.
    """
    own = integer_vectors(vectors, dims, id_col, vector_col)
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = own.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, dims)
    rows = own.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), len(first)))
    last, before = np.zeros_like(centroids), None
    for turn in range(rounds + 1):
        rows = staged(rows.select("vec_id", "x", "dots").mapInArrow(assigned(centroids - last, (centroids * centroids).sum(axis=1)), SCHEMA), "distances") if len(first) else own.sparkSession.createDataFrame([], SCHEMA)
        if before is not None:
            discard(before)
        if turn == rounds or not len(first):
            break
        new = floored_means(rows, centroids)
        if (new == centroids).all():
            break
        last, centroids, before = centroids, new, rows
    return rows, centroids


def centroid_clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector; options and edge cases as in ``clustered``."""
    rows, centroids = clustered(vectors, **options)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    named = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    small = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:") -> str:
    """The same by SQL, a round after the other, every distance from scratch."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} as materialized (select v.rid, c.k, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{r} c using (i) group by v.rid, c.k),
a{r} as materialized (select rid, k, d from d{r} qualify row_number() over (partition by rid order by d, k) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} as (select a.k, v.i, sum(v.x)::hugeint as s, count(*)::hugeint as n from a{r} a join v using (rid) group by a.k, v.i),
c{r + 1} as materialized (select c.k, c.i, coalesce((case when m.s >= 0 then m.s // m.n else -((-m.s + m.n - 1) // m.n) end)::bigint, c.x) as x from c{r} c left join m{r} m on m.k = c.k and m.i = c.i)""")
    return f"""with kept as materialized (select row_number() over (order by vec_id) as rid, vec_id, embedding from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
v as materialized (select rid, unnest(range(1, {dims + 1})) as i, unnest(list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint)) as x from kept),
first_ as (select rid, row_number() over (order by sha256('{seed}' || coalesce(vec_id::varchar, '')), embedding) - 1 as k from kept qualify k < {k}),
c0 as materialized (select f.k, v.i, v.x from first_ f join v using (rid)),
{', '.join(steps)},
named as (select k, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by k)
select kept.vec_id, a.k::integer as cluster, a.d as distance, sum(a.d) over (partition by a.k)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia, centroid_sha256
from a{rounds} a join kept using (rid) join named using (k)"""
