"""Best-fit packing by linear grouping.

Which lengths share a sequence depends on the histogram of piece lengths alone, which has one
entry for each length up to the capacity. So the scheme runs on that histogram and its plan is a
list of runs: "the pieces of this length with these ranks go to these sequences at this offset".
Executors rank pieces within their length and look their place up.

1. Lengths over ``large_from`` are sorted and cut into groups of equal cardinality; each rounds up
   to its group's largest length.
2. Configurations of these few sizes are optimised by column generation: a linear programme over
   bins, new configurations priced by a knapsack; its fractions go first-fit.
3. Actual pieces, longest first, take the slots of their group.
4. Small pieces, longest first, go where least room is left over.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.encoding import encoder, slices, with_end
from factloom.llm.shared import staged

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, piece, start and length of all pieces of documents of so many ids; only a first piece may be short."""
    pieces = (sizes - 1) // capacity + 1
    doc = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = sizes - (pieces - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document, with their ids if asked for. Null texts are empty: one piece of the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = with_end(*enc.encode(part.column("text")), end_id)
                doc, piece, start, length = cuts(np.diff(ends), capacity)
                raw, at = memoryview(ids.tobytes()), ends[doc] + start
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
                cols = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def price(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill a bin at the highest worth: an unbounded knapsack over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = sizes <= c
        got = np.where(fits, best[np.where(fits, c - sizes, 0)] + worth, -1.0)
        k = int(got.argmax())
        best[c], pick[c] = (got[k], k) if got[k] > best[c - 1] else (best[c - 1], -1)
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how often each is used, for at least ``counts`` of the sizes."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        column = price(sizes, np.maximum(worth, 0), capacity)
        if column @ worth <= 1 + 1e-7:
            break
        use, turn = np.linalg.solve(basis, counts.astype(float)), np.linalg.solve(basis, column)
        ok = turn > 1e-9
        if not ok.any():
            break
        out = int(np.where(ok, np.maximum(use, 0) / np.where(ok, turn, 1), np.inf).argmin())
        basis[:, out] = column
    use = np.maximum(np.linalg.solve(basis, counts.astype(float)), 0)
    found, left = [], counts.copy()
    for j in np.argsort(-use):
        own = basis[:, j].astype(int)
        n = int(use[j] + 1e-6)
        if n:
            found.append((own, n))
            left = left - own * n
    bins: list[np.ndarray] = []
    for g in np.argsort(-sizes):
        for _ in range(max(0, int(left[g]))):
            home = next((b for b in bins if b @ sizes + sizes[g] <= capacity), None)
            if home is None:
                bins.append(home := np.zeros(k, dtype=int))
            home[g] += 1
    return found + [(b, 1) for b in bins]


@dataclass
class Plan:
    """Runs (length, first rank, count, first sequence, offset) and how many sequences they use."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def plan_packing(histogram: dict[int, int], capacity: int = 1024, *, large_from: int = 256, groups: int = 128) -> Plan:
    """Place every piece of a histogram {length: count}; lengths from 1 to ``capacity``."""
    plan, rank = Plan(), dict.fromkeys(histogram, 0)
    cohorts: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, count)
    rooms: list[int] = []

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in cohorts:
                insort(rooms, room)
            cohorts.setdefault(room, []).append((first, count))

    def place(length: int, count: int, first: int, offset: int) -> None:
        plan.runs.append((length, rank[length], count, first, offset))
        rank[length] += count

    large = sorted((x for x in histogram if x > large_from and histogram[x]), reverse=True)
    total = sum(histogram[x] for x in large)
    if total:
        n_groups = min(groups, total)
        edge = [total * g // n_groups for g in range(n_groups + 1)]
        spans, at, g = [[] for _ in range(n_groups)], 0, 0
        for x in large:
            n = histogram[x]
            while n:
                take = min(n, edge[g + 1] - at)
                if take:
                    spans[g].append([x, take])
                at, n = at + take, n - take
                while g + 1 < n_groups and at == edge[g + 1]:
                    g += 1
        merged: dict[int, list[list[int]]] = {}
        for own in spans:  # groups with one rounded size are one
            if own:
                merged.setdefault(own[0][0], []).extend(own)
        sizes = np.array(sorted(merged, reverse=True))
        queues = [merged[s] for s in sizes.tolist()]
        counts = np.array([sum(n for _, n in q) for q in queues])
        heads = [0] * len(queues)
        for pattern, times in configurations(sizes, counts, capacity):
            slots = [g for g in np.flatnonzero(pattern).tolist() for _ in range(int(pattern[g]))]
            filled = []
            for g in slots:
                need, got = times, []
                while need and heads[g] < len(queues[g]):
                    run = queues[g][heads[g]]
                    n = min(need, run[1])
                    got.append((run[0], n))
                    run[1] -= n
                    need -= n
                    heads[g] += run[1] == 0
                filled.append(got)
            marks = sorted({0, times, *(m for got in filled for m in np.cumsum([n for _, n in got]).tolist())})
            pos = [[0, 0] for _ in slots]
            for a, b in zip(marks, marks[1:], strict=False):
                offset = 0
                for k, got in enumerate(filled):
                    if pos[k][0] < len(got):
                        length, n = got[pos[k][0]]
                        place(length, b - a, plan.sequences, offset)
                        offset += length
                        pos[k][1] += b - a
                        if pos[k][1] == n:
                            pos[k] = [pos[k][0] + 1, 0]
                if offset:
                    keep(capacity - offset, plan.sequences, b - a)
                    plan.sequences += b - a
    for length in sorted((x for x in histogram if x <= large_from and histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                need = -(-left // each)
                first, count, room = plan.sequences, need, capacity
                plan.sequences += need
            else:
                room = rooms[k]
                first, count = cohorts[room].pop()
                if not cohorts[room]:
                    del cohorts[room], rooms[k]
            each = room // length
            whole = min(count, left // each)
            for t in range(each if whole else 0):
                place(length, whole, first, capacity - room + t * length)
            keep(room - each * length, first, whole)
            left -= whole * each
            if whole < count and left:
                for t in range(left):
                    place(length, 1, first + whole, capacity - room + t * length)
                keep(room - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            keep(room, first + whole, count - whole)
    return plan


def pack(pieces: DataFrame, *, capacity: int = 1024, large_from: int = 256, groups: int = 128, rows_a_salt: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, start, length, ids_crc32, and any others).

    ``pieces`` should be a written table: it is read for its histogram, its ranks and its rows.
    A length that many pieces share is ranked in salted parts. An empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most one row for each length up to the capacity
    plan = plan_packing(histogram, capacity, large_from=large_from, groups=groups)
    runs = sorted(plan.runs)
    keys = spark.sparkContext.broadcast(np.array([(n, r, s, o) for n, r, _, s, o in runs], dtype=np.int64).reshape(-1, 4))
    salts = int(min(1 << 16, max(64, sum(histogram.values()) // rows_a_salt)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")))
    placed = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_at") - 1)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = keys.value
        found = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(found, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], names=[*names, "sequence_id", "offset"])

    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return placed.select(*names, "_rank").mapInArrow(find, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Null and empty texts have one piece, the end id. Repeated rows are packed as often as they
    come. Null ids stay null. A very long text is encoded whole and cut into pieces of ``capacity`` tokens, the
    first one shorter if need be; pieces of equal length may take each other's places, as sequences
    hold the same tokens then. An empty table gives an empty result. Other columns are ignored.
    """
    return pack(staged(token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity)
