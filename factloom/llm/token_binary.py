"""Token ids in a binary format: static range asymmetric numeral systems (rANS).

One frequency table for the whole corpus is shared by all blocks. A block is a run of whole
documents; its ids are dealt to interleaved lanes, each with its own 64-bit state, so that numpy
codes one symbol of every lane at a time. Blocks hold nothing of each other, and inside a block
checkpoints keep all lane states and the place in the word stream, so a long block decodes in parts
too. Checksums cover the words and the ids.

A written corpus is a folder of Parquet tables, which any store that Spark reads can hold and
which a retried task can't leave half written:
``table`` (token_id, freq), ``blocks`` (part, block, n_tokens, doc_ids, lengths, payload, checksums).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.encoding import encoder, slices, with_end
from factloom.llm.shared import staged

SCALE_BITS = 18
LOW = np.uint64(1 << 31)
BLOCK_TOKENS = 1 << 20
MAX_LANES = 4096
CHECK_STEPS = 128
BLOCKS = "part int, block int, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, lanes int, words binary, states binary, marks array<bigint>, mark_states binary, words_crc32 bigint, ids_crc32 bigint"
DOCS = "doc_id bigint, part int, block int, at bigint, n_tokens bigint, ids_crc32 bigint"


def quantised(counts: dict[int, int], bits: int = SCALE_BITS) -> dict[int, int]:
    """Frequencies that sum to ``2 ** bits``, at least 1 for each id that occurs; at most ``2 ** bits`` distinct ids."""
    total, room = sum(counts.values()), 1 << bits
    if len(counts) > room:
        raise ValueError(f"{len(counts)} distinct ids don't fit {bits} bits")
    freq = {t: max(1, c * room // total) for t, c in counts.items()}
    over = sum(freq.values()) - room
    for t in sorted(freq, key=lambda t: (-freq[t], t)):
        if over <= 0:
            freq[t] -= over  # what is missing goes to the most frequent id
            break
        step = min(over, freq[t] - 1)
        freq[t] -= step
        over -= step
    return freq


class Coder:
    """Codes arrays of ids with one frequency table."""

    def __init__(self, freq: dict[int, int], bits: int = SCALE_BITS):
        ids = np.array(sorted(freq), dtype=np.int64)
        f = np.array([freq[t] for t in ids.tolist()], dtype=np.uint64)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids], self.cum[ids] = f, np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64) if len(ids) else f
        self.slot = np.repeat(ids, f.astype(np.int64)).astype(np.uint32)
        self.bits, self.pad = np.uint64(bits), int(ids[f.argmax()]) if len(ids) else 0

    def lanes(self, n: int) -> int:
        return int(min(MAX_LANES, max(1, 1 << max(0, (n // 64).bit_length() - 1))))

    def encode(self, ids: np.ndarray) -> dict:
        n, bits = len(ids), self.bits
        lanes = self.lanes(n)
        steps = -(-n // lanes)
        rows = np.full(steps * lanes, self.pad, dtype=np.int64)
        rows[:n] = ids
        rows = rows.reshape(steps, lanes)
        x = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        marks, states = [], []
        for t in range(steps - 1, -1, -1):
            f = self.freq[rows[t]]
            full = x >= (f << (np.uint64(63) - bits))
            words.append(x[full].astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            q, r = np.divmod(x, f)
            x = (q << bits) + r + self.cum[rows[t]]
            if t and t % CHECK_STEPS == 0:
                marks.append(t)
                states.append(x.copy())
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        lengths = np.cumsum([0, *(len(w) for w in words[::-1])])
        at = [v for t in marks[::-1] for v in (t, int(lengths[t]))]
        return {"lanes": lanes, "words": stream.tobytes(), "states": x.astype("<u8").tobytes(), "marks": at, "mark_states": b"".join(s.astype("<u8").tobytes() for s in states[::-1])}

    def decode(self, coded: dict, n: int, part: int | None = None) -> np.ndarray:
        """All ``n`` ids, or those between checkpoint ``part`` (0: the start) and the next one."""
        lanes, bits = coded["lanes"], self.bits
        steps = -(-n // lanes)
        stream = np.frombuffer(coded["words"], "<u4")
        x = np.frombuffer(coded["states"], "<u8").astype(np.uint64)
        first, last, at = 0, steps, 0
        if part is not None:
            marks = list(coded["marks"])
            turns = marks[::2]
            last = turns[part] if part < len(turns) else steps
            if part:
                first, at = marks[2 * part - 2], marks[2 * part - 1]
                x = np.frombuffer(coded["mark_states"], "<u8").reshape(-1, lanes)[part - 1].astype(np.uint64)
        out = np.empty((last - first, lanes), dtype=np.uint32)
        mask = np.uint64((1 << int(bits)) - 1)
        for t in range(last - first):
            low = x & mask
            s = self.slot[low.astype(np.int64)]
            out[t] = s
            x = self.freq[s] * (x >> bits) + low - self.cum[s]
            need = x < LOW
            k = int(need.sum())
            if k:
                x[need] = (x[need] << np.uint64(32)) | stream[at : at + k]
                at += k
        return out.reshape(-1)[: max(0, n - first * lanes)]


def narrowed(ids: np.ndarray) -> tuple[bytes, int]:
    """Ids compressed for the way to their block: two bytes each where they fit."""
    own = ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
    return pa.compress(own.tobytes(), codec="zstd", asbytes=True), own.itemsize


def widened(raw: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=f"<u{size}")


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, tie, n, size, ids of every document: encoded once, compressed and staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = with_end(*enc.encode(part.column("text")), end_id)
                at = ends.tolist()
                found = [narrowed(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(np.diff(ends)), pa.array([x[1] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.binary())], names=["doc_id", "tie", "n", "size", "ids"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return staged(rows.mapInArrow(run, "doc_id bigint, tie bigint, n bigint, size int, ids binary"), "token-ids", "uncompressed")


def frequency_table(coded: DataFrame) -> dict[int, int]:
    """How often each id occurs in the whole corpus; as many entries as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.bincount(widened(raw, n, size), minlength=len(total))
                own[: len(total)] += total
                total = own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["token_id", "n"])

    rows = coded.select("n", "size", "ids").mapInArrow(run, "token_id bigint, n bigint").groupBy("token_id").agg(F.sum("n").alias("n")).collect()
    return {int(r[0]): int(r[1]) for r in rows}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), each with ``end_id`` behind, and write them in ascending order of ids.

    Null ids come first, repeated ids in the order of their texts' hashes; of wholly equal rows, which have
    equal ids, any comes first. Very long texts are encoded whole and may take several blocks. An empty table writes
    empty tables. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids_rows = encoded(rows, tokenizer_path, end_id)
    freq = quantised(frequency_table(ids_rows))
    spark.createDataFrame(sorted(freq.items()), "token_id bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block = Coder(shared.value), TaskContext.get().partitionId(), 0
        docs_now, lengths, ids_now, n = [], [], [], 0

        def finish() -> pa.RecordBatch:
            ids = np.concatenate(ids_now)
            coded = coder.encode(ids)
            values = [part, block, n, docs_now, lengths, coded["lanes"], coded["words"], coded["states"], coded["marks"], coded["mark_states"], zlib.crc32(coded["words"]), zlib.crc32(ids.astype("<u4").tobytes())]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, m, size, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "size", "ids")), strict=True):
                docs_now.append(doc)
                lengths.append(m)
                ids_now.append(widened(raw, m, size))
                n += m
                if n >= block_tokens:
                    yield finish()
                    block += 1
                    docs_now, lengths, ids_now, n = [], [], [], 0
        if n:
            yield finish()

    ids_rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files; start counts all ids before it.

    A block whose words or ids don't match their checksums raises.
    """
    shared = spark.sparkContext.broadcast({int(r[0]): int(r[1]) for r in spark.read.schema("token_id bigint, freq bigint").parquet(f"{path}/table").collect()})
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["words"]) != row["words_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']}: its words are damaged")
                ids = coder.decode(row, row["n_tokens"])
                raw = memoryview(ids.astype("<u4").tobytes())
                if zlib.crc32(raw) != row["ids_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']}: its ids are damaged")
                ends = np.concatenate([[0], np.cumsum(np.array(row["lengths"], dtype=np.int64))])
                at = ends.tolist()
                k = len(row["doc_ids"])
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())]
                names = ["doc_id", "part", "block", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    decoded = blocks.mapInArrow(run, DOCS + ", ids array<int>" * with_ids)
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each written part: thousands
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto.orderBy("part")), F.lit(0)).alias("_part_start"))
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(upto.partitionBy("part").orderBy("block")), F.lit(0)).alias("_block_start")).join(parts, "part")
    out = decoded.join(starts, ["part", "block"]).withColumn("start", F.col("_part_start") + F.col("_block_start") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
