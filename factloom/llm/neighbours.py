"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Largest inner product becomes least distance by one more coordinate: sqrt(M^2 - |x|^2) for a
vector, 0 for a query, M the largest norm. Vectors are projected by Gaussian (2-stable) directions
to a few dimensions, so projected squared distance over true squared distance follows a chi-square
law. The top of the kd-tree is cut on a bounded sample of projections; its cells are blocks, in which
all vectors are, and each block has the rest of the tree over its own projections. A search meets points
in order of projected distance, leaf by leaf, verifies them on the original vectors and stops when
the next one is so far out that a better neighbour behind it has a chance of at most ``1 - sure``.
First a query searches the block nearest to it; by the distance found there it skips all blocks that
the same test rules out. Of the others it searches the ``NEAR`` nearest ones next, skips by the better
distance again, searches what is left, and its answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import staged

DIMS, LEAF, BLOCK_ROWS, QUERY_ROWS, NEAR = 8, 64, 8192, 2048, 3
SAMPLE_ROWS, MOST_BLOCKS = 100_000, 50_000
INDEX = "block bigint, ids binary, vectors binary, points binary, starts binary, low binary, high binary, box binary"


def chi_square_bound(sure: float, dims: int) -> float:
    """The x with P(chi-square <= x) = ``sure``, for an even number of degrees of freedom."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    a, b = 0.0, 1000.0
    for _ in range(100):
        a, b = ((a + b) / 2, b) if below((a + b) / 2) < sure else (a, (a + b) / 2)
    return b


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of points by leaf of a kd-tree (median cuts of the widest side) and the start of each leaf."""
    out, starts, todo = [], [], [np.arange(len(points))]
    at = 0
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            starts.append(at)
            at += len(own)
            continue
        side = int(np.ptp(points[own], axis=0).argmax())
        half = len(own) // 2
        cut = np.argpartition(points[own, side], half)
        todo += [own[cut[half:]], own[cut[:half]]]
    return np.concatenate(out), np.array(starts, dtype=np.int64)


@dataclass
class Cells:
    """The top of a kd-tree: nodes (side, cut, below, above); a leaf has side -1 and its first block and number of blocks."""

    side: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def blocks(self, points: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The block of each point; where a cell has several, its salt decides."""
        at = np.zeros(len(points), np.int64)
        while len(points) and (self.side[at] >= 0).any():
            side = self.side[at]
            go = np.where(points[np.arange(len(points)), np.maximum(side, 0)] < self.cut[at], self.below[at], self.above[at])
            at = np.where(side >= 0, go, at)
        return self.below[at] + salt % np.maximum(1, self.above[at])


def best_cut(points: np.ndarray, n: int) -> tuple[int, float]:
    """The side and the share of points below it that leave the least variance, among shares of whole blocks from a quarter to three quarters of ``n``.

    So clusters mostly stay whole, and cells stay parts of about equal size.
    """
    m = len(points)
    ks = np.arange(max(1, n // 4), min(n - 1, -(-3 * n // 4)) + 1)
    at = np.clip(np.rint(m * ks / n).astype(np.int64), 1, max(1, m - 1))
    best = (-1.0, int(np.ptp(points, axis=0).argmax()), (n // 2) / n)
    for side in range(points.shape[1]):
        total = np.cumsum(np.sort(points[:, side] - points[:, side].mean()))
        won = total[at - 1] ** 2 * m / (at * np.maximum(1, m - at))  # between the two parts, as the sum over all is 0
        k = int(won.argmax())
        if won[k] > best[0] * (1 + 1e-9):
            best = (float(won[k]), side, float(ks[k]) / n)
    return best[1:]


def top_cells(points: np.ndarray, blocks: int) -> Cells:
    """Cells of about equal parts of a sample, as many as blocks. A cell of one point takes the blocks that its share calls for."""
    nodes: list[list] = []
    first = 0

    def grow(own: np.ndarray, n: int) -> int:
        nonlocal first
        k = len(nodes)
        nodes.append([-1, 0.0, 0, 1])
        spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(points.shape[1])
        if n > 1 and spread.max() > 0:
            side, share = best_cut(points[own], n)
            values = points[own, side]
            cut = float(np.quantile(values, share))
            cut = cut if cut > values.min() else float(values[values > cut].min())
            low = values < cut
            share = min(n - 1, max(1, round(n * float(low.mean()))))
            nodes[k] = [side, cut, grow(own[low], share), grow(own[~low], n - share)]
        else:
            nodes[k] = [-1, 0.0, first, n]
            first += n
        return k

    grow(np.arange(len(points)), blocks)
    side, cut, below, above = zip(*nodes, strict=True)
    return Cells(np.array(side), np.array(cut), np.array(below, dtype=np.int64), np.array(above, dtype=np.int64))


def directions(dim: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, dims))


def beyond(x: np.ndarray, norm: float) -> np.ndarray:
    """The coordinate that brings all vectors to one norm."""
    return np.sqrt(np.maximum(0, (norm * (1 + 1e-12)) ** 2 - (x * x).sum(1)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double): one row for each id; vectors null, zero or with odd components are left out."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, dict]:
    """The index (a row for each block, written), the usable vectors (written) and its figures."""
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    found = rows.agg(F.count("*"), F.mode(F.size("v")), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    count, dim, norm = int(found[0]), int(found[1] or 1), float(found[2] or 1.0)
    rows = rows.where(F.size("v") == dim)
    blocks = min(MOST_BLOCKS, max(1, -(-count // block_rows)))
    ways = directions(dim)

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return np.concatenate([x, beyond(x, norm)[:, None]], 1) @ ways

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(projected(batch)), pa.list_(pa.float64()))], names=["point"])

    share = min(1.0, SAMPLE_ROWS / max(1, count))
    points = np.array([r[0] for r in (rows.sample(fraction=share, seed=3) if share < 1 else rows).mapInArrow(sampled, "point array<double>").collect()] if blocks > 1 else []).reshape(-1, DIMS)
    cells = rows.sparkSession.sparkContext.broadcast(top_cells(points[np.lexsort(points.T)], blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = cells.value.blocks(projected(batch), batch.column("salt").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(block)], names=["vec_id", "v", "block"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(b.num_rows for b in parts):
            return
        t = pa.Table.from_batches(parts)
        ids = t.column("vec_id").to_numpy()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]).reshape(-1, dim)
        points = np.concatenate([x, beyond(x, norm)[:, None]], 1) @ ways
        order, starts = kd_leaves(points)
        points = points[order]
        low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        values = [int(t.column("block")[0].as_py()), ids[order].tobytes(), x[order].tobytes(), points.tobytes(), starts.tobytes(), low.tobytes(), high.tobytes(), low.min(0).tobytes() + high.max(0).tobytes()]
        names = [c.split()[0] for c in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), *(pa.array([b], pa.binary()) for b in values[1:])], names=names)

    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).alias("salt")).mapInArrow(deal, "vec_id bigint, v array<double>, block bigint")
    index = staged(dealt.groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(list(build(iter(t.to_batches())))), INDEX), "vector-index", "uncompressed")
    return index, rows, {"dim": dim, "norm": norm, "blocks": blocks}


def search_block(tree: dict, query: np.ndarray, own: int, k: int, norm: float, ways: np.ndarray, bound: float, worst: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the best ``k`` in one block for one query, own id left out; ``worst``: squared distance of the k-th best known."""
    spot = np.append(query, 0.0) @ ways
    gap = np.maximum(0, np.maximum(tree["low"] - spot, spot - tree["high"]))
    near = (gap * gap).sum(1)
    order = np.argsort(near, kind="stable")
    sizes = np.diff(np.append(tree["starts"], len(tree["ids"])))
    base = norm * norm + float(query @ query)
    at, batch = 0, 4
    waiting, wait_d = np.zeros(0, np.int64), np.zeros(0)
    seen, score = [], []
    if len(near) and near.min() > bound * worst:
        return np.zeros(0, np.int64), np.zeros(0)
    while True:
        if at < len(order):
            leaves = order[at : at + batch]
            at, batch = at + batch, min(64, batch * 2)
            rows = np.repeat(tree["starts"][leaves] - np.append(0, np.cumsum(sizes[leaves])[:-1]), sizes[leaves]) + np.arange(int(sizes[leaves].sum()))
            d = tree["points"][rows] - spot
            waiting, wait_d = np.append(waiting, rows), np.append(wait_d, (d * d).sum(1))
        next_leaf = near[order[at]] if at < len(order) else np.inf
        due = wait_d <= next_leaf
        rows = waiting[due]
        waiting, wait_d = waiting[~due], wait_d[~due]
        if len(rows):
            rows = rows[tree["ids"][rows] != own]
            seen.append(rows)
            score.append(tree["vectors"][rows] @ query)
            every = np.concatenate(score)
            if len(every) >= k:
                worst = min(worst, max(0.0, base - 2 * float(np.partition(every, len(every) - k)[len(every) - k])) * (1 + 1e-9) + 1e-12)
        if next_leaf == np.inf and not len(waiting) or min(next_leaf, wait_d.min() if len(wait_d) else np.inf) > bound * worst:
            break
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0)
    rows, every = np.concatenate(seen), np.concatenate(score)
    if len(rows) > k:
        cut = np.partition(every, len(every) - k)[len(every) - k]
        rows = rows[every >= cut - 1e-9 * max(1.0, abs(cut))]
    exact = (tree["vectors"][rows] * query).sum(1)  # row by row: equal vectors have equal products
    ids = tree["ids"][rows]
    best = np.lexsort((ids, -exact))[:k]
    return ids[best], exact[best]


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, sure: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every``, its ``k`` largest inner products.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id and vectors of another length than most, which have no inner product with these. Of
    rows with one id, which no result could tell apart, the least vector counts. Ties go to the
    smaller id. With fewer candidates all are returned; an empty table gives an empty result. Other columns are ignored, whatever their names.
    ``told`` is given the numbers of queries and blocks, and of the pairs of these that were searched.
    """
    index, rows, figures = build_index(vectors, id_col=id_col, vector_col=vector_col, block_rows=block_rows)
    spark = vectors.sparkSession
    dim, norm, bound = figures["dim"], figures["norm"] * (1 + 1e-12), chi_square_bound(sure, DIMS)
    ways = directions(dim)
    # a row for each block, MOST_BLOCKS at most: the box of its projections
    found = index.select("block", F.col("box")).collect()
    numbers = np.array([r[0] for r in found], dtype=np.int64)
    boxes = np.array([np.frombuffer(r[1], np.float64) for r in found]).reshape(len(found), 2, DIMS)
    shared = spark.sparkContext.broadcast((numbers, boxes))

    def gaps(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Squared projected distances of each query to all blocks."""
        low, high = shared.value[1][:, 0], shared.value[1][:, 1]
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for spot in np.concatenate([x, np.zeros((len(x), 1))], 1) @ ways:
            gap = np.maximum(0, np.maximum(low - spot, spot - high))
            yield (gap * gap).sum(1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = [int(shared.value[0][g.argmin()]) for g in gaps(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([float("inf")] * len(block), pa.float64()), pa.array(block, pa.int64())], names=["vec_id", "v", "worst", "block"])

    def next_ones(g: np.ndarray, worst: float, first: int) -> np.ndarray:
        """Places of the ``NEAR`` nearest blocks but its home that a query can't skip."""
        left = np.flatnonzero((g <= bound * worst) & (shared.value[0] != first))
        return left[np.argsort(g[left], kind="stable")[:NEAR]]

    def others(near: bool):
        """The blocks that a query searches after its home: the nearest ones, or what is left after them by the better distance."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left = []
                for g, worst, better, first in zip(gaps(batch), *(batch.column(c).to_numpy() for c in ("worst", "better", "home")), strict=True):
                    own = next_ones(g, worst, first)
                    if not near:
                        open_ = (g <= bound * better) & (shared.value[0] != first)
                        open_[own] = False
                        own = np.flatnonzero(open_)
                    left.append(shared.value[0][own])
                at = np.repeat(np.arange(batch.num_rows), [len(x) for x in left])
                picked = batch.select(["vec_id", "v", "better"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(left) if left else np.zeros(0, np.int64))], names=["vec_id", "v", "worst", "block"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                raw = lambda c, kind: np.frombuffer(row[c].as_buffer(), dtype=kind)  # noqa: B023, E731
                tree = {"ids": raw("ids", np.int64), "vectors": raw("vectors", np.float64).reshape(-1, dim), "starts": raw("starts", np.int64)}
                tree |= {c: raw(c, np.float64).reshape(-1, DIMS) for c in ("points", "low", "high")}
                ids, worst = (row[c].values.to_numpy() for c in ("query_ids", "worsts"))
                queries_here = row["queries"].values.to_numpy().reshape(-1, dim)
                got = [search_block(tree, q, int(n), k, norm, ways, bound, float(w)) for n, q, w in zip(ids, queries_here, worst, strict=True)]
                sizes = [len(g[0]) for g in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], names=["query_id", "vec_id", "score"])

    queries = rows.where((F.size("v") == dim) & (F.col("vec_id") % every == 0))
    lots = max(1, -(-queries.count() // QUERY_ROWS))

    def answers(asked: DataFrame) -> DataFrame:
        """Answers of queries (vec_id, v, worst, block), each in its block; a block meets its queries in lots."""
        lot = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots))
        grouped = asked.groupBy("block", lot.alias("lot")).agg(F.collect_list(F.struct("vec_id", "worst", "v")).alias("q"))
        grouped = grouped.select("block", F.col("q.vec_id").alias("query_ids"), F.col("q.worst").alias("worsts"), F.flatten("q.v").alias("queries"))
        return staged(grouped.join(index, "block").mapInArrow(run, "query_id bigint, vec_id bigint, score double"), "answers")

    asked = staged(queries.mapInArrow(home, "vec_id bigint, v array<double>, worst double, block bigint"), "queries")
    first = answers(asked)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)

    def reached(got: DataFrame, name: str) -> DataFrame:
        """query_id and the squared distance of the k-th best answer so far; infinite with fewer."""
        best = got.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("_n") == k).select("query_id", F.col("score").alias("kth"))
        worst = F.coalesce(F.greatest(F.lit(0.0), F.lit(norm * norm) + length - 2 * F.col("kth")) * (1 + 1e-9) + 1e-12, F.lit(float("inf")))
        return asked.join(best, asked["vec_id"] == best["query_id"], "left").select("vec_id", worst.alias(name))

    if len(found) > 1:
        schema = "vec_id bigint, v array<double>, worst double, block bigint"
        homes = asked.select("vec_id", "v", F.col("block").alias("home")).join(reached(first, "worst"), "vec_id")
        near = staged(homes.withColumn("better", F.col("worst")).mapInArrow(others(True), schema), "queries")
        second = first.union(answers(near))
        rest = staged(homes.join(reached(second, "better"), "vec_id").mapInArrow(others(False), schema), "queries")
        if told is not None:
            told |= {"queries": asked.count(), "blocks": len(found), "near": near.count(), "rest": rest.count()}
        first = second.union(answers(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
