"""BPE encoding with content-defined chunks: what documents share is encoded once.

A rolling hash cuts every text into chunks. Chunks that occur once stay where they are: runs of them
are encoded in place. Chunks that occur again, anywhere, are encoded once and their ids are joined
back. Where two pieces meet, the ids around the join are encoded again, from one place where the
tokenizer surely begins a pre-token to another, and the window grows until its ids agree with both
pieces outside the join. Decoding takes each id's bytes.

Which chunks occur again is asked of a Bloom filter of a bounded size. A chunk that passes it wrongly
is treated as one that occurs again, so results don't depend on it.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encoding import BYTE_CHARS, encoder, slices
from factloom.llm.shared import discard, staged

#: A cut is made where the low bits of the rolling hash are zero, on average every 2^CUT_BITS bytes.
CUT_BITS, LEAST_CHUNK = 8, 64
#: Bytes that a rolling hash of 32 bits holds.
HASHED = 32
#: The Bloom filter has 16 bits for each repeated chunk, and so many bits at most (32 MB); beyond that it fills and more chunks count as repeated.
MOST_FILTER_BITS = 28
FILTER_BLOCK = 1 << 15
SEEN = 100_000


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte value, the same in every process."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=11) for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def chunk_ends(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the end of each chunk, the number of chunks of each text).

    The rolling hash of 32 bytes is made of those of 16, 8, ... A cut stays if it is between
    characters and ``LEAST_CHUNK`` bytes behind the last candidate and the text's begin, so that cuts
    depend on some bytes before them only, and never on another text: equal texts have equal chunks.
    """
    h = GEAR[data]
    for n in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h = longer
    inner = np.flatnonzero((h[:-1] >> np.uint32(32 - CUT_BITS) == 0) & (data[1:] & 0xC0 != 0x80)) + 1 if len(data) else np.zeros(0, np.int64)
    last = ends[1:][np.diff(ends) > 0]
    inner = inner[~np.isin(inner, ends)]
    start = ends[np.searchsorted(ends, inner, side="right") - 1] if len(inner) else inner
    own = inner - start >= HASHED  # the others' hashes hold bytes of the text before
    inner, start = inner[own], start[own]
    gap = np.diff(inner, prepend=-LEAST_CHUNK)
    inner = inner[(np.minimum(gap, inner - start) >= LEAST_CHUNK)]
    cuts = np.union1d(inner, last)
    return cuts, np.diff(np.searchsorted(cuts, ends, side="right"))


def chunked(texts: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begins and ends of chunks, their 64-bit hashes, the first chunk of each text (with the end)."""
    data, ends = data_of(texts)
    cuts, counts = chunk_ends(data, ends)
    begins = np.concatenate([[0], cuts[:-1]]).astype(np.int64) if len(cuts) else cuts
    view = memoryview(np.ascontiguousarray(data))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begins.tolist(), cuts.tolist(), strict=True)), np.uint64, len(cuts))
    return view, begins, cuts, hashes, np.concatenate([[0], np.cumsum(counts)])


def listed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, text_digest, chunks)."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, ends = data_of(part.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            *_, hashes, first = chunked(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), lists], names=["doc_id", "text_digest", "chunks"])


class Filter:
    """A Bloom filter with two probes, in blocks of bits."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(bits)
        whole = bytearray(1 << max(0, bits - 3))
        for k, b in blocks.items():
            whole[k * FILTER_BLOCK // 8 : k * FILTER_BLOCK // 8 + len(b)] = b
        self.bytes = np.frombuffer(bytes(whole), dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in (hashes & self.mask, (hashes >> self.shift) & self.mask):
            at = at.astype(np.int64)
            out &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bit) of one partition, all of each block -> (block, bits)."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        block, bit = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
        for k in np.unique(block):
            blocks.setdefault(int(k), np.zeros(FILTER_BLOCK, dtype=np.uint8))[bit[block == k]] = 1
    packed = [np.packbits(b, bitorder="little").tobytes() for b in blocks.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(packed, pa.binary())], names=["block", "bits"])


def repeated_filter(listed: DataFrame) -> Filter:
    """The filter of chunks that occur twice or more in all; its blocks reach the driver, 2^``MOST_FILTER_BITS`` bits at most."""
    again = staged(listed.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk"), "repeated-chunks")
    bits = min(MOST_FILTER_BITS, max(15, int(again.count() * 16).bit_length()))
    place = lambda shift: F.shiftrightunsigned("chunk", shift).bitwiseAND((1 << bits) - 1)
    spots = again.select(F.explode(F.array(place(0), place(bits))).alias("at")).select(F.floor(F.col("at") / FILTER_BLOCK).cast("long").alias("block"), (F.col("at") % FILTER_BLOCK).cast("int").alias("bit"))
    blocks = spots.repartition(F.col("block")).mapInArrow(filter_blocks, "block bigint, bits binary").collect()
    out = Filter(bits, {r["block"]: bytes(r["bits"]) for r in blocks})
    discard(again)
    return out


class Seen:
    """The keys met lately, ``SEEN`` at most: what a task has sent it needn't send again."""

    def __init__(self):
        self.keys: OrderedDict[bytes, None] = OrderedDict()

    def add(self, key: bytes) -> bool:
        """Whether the key is new."""
        if key in self.keys:
            self.keys.move_to_end(key)
            return False
        self.keys[key] = None
        if len(self.keys) > SEEN:
            self.keys.popitem(last=False)
        return True


def digest(piece) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def repeated_chunks(known: Broadcast):
    """texts -> (digest, chunk) of chunks that pass the filter, each once for a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch, "text"):
                view, begins, cuts, hashes, _ = chunked(part.column("text"))
                keys, texts = [], []
                for k in np.flatnonzero(known.value.has(hashes)).tolist():
                    piece = view[begins[k] : cuts[k]]
                    if seen.add(key := digest(piece)):
                        keys.append(key)
                        texts.append(bytes(piece))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], names=["digest", "chunk"])

    return run


def stored_as(table: pa.Array) -> np.dtype:
    """How ids lie in staged tables: two bytes each where the vocabulary fits, else four."""
    return np.dtype("<u2" if len(table) <= 1 << 16 else "<u4")


def binary_ids(ids: np.ndarray, ends: np.ndarray, kind: np.dtype) -> pa.Array:
    """Ids as little-endian unsigned integers, a value for each text."""
    raw, n = np.ascontiguousarray(ids, dtype=kind).tobytes(), kind.itemsize
    return pa.array([raw[n * a : n * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def encoded_chunks(tokenizer_path: str):
    """(digest, chunk) -> (digest, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind = encoder(tokenizer_path), stored_as(bytes_of_ids(tokenizer_path))
        for batch in batches:
            for part in slices(batch, "chunk"):
                yield pa.RecordBatch.from_arrays([part.column("digest"), binary_ids(*enc.encode(part.column("chunk")), kind)], names=["digest", "ids"])

    return run


@lru_cache(maxsize=4)
def bytes_of_ids(tokenizer_path: str) -> pa.Array:
    """The bytes of each id of a byte-level tokenizer; of an added token those of its text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {chr(shown): byte for byte, shown in BYTE_CHARS.items()}
    out: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([out.get(i, b"") for i in range(max(out) + 1)], pa.large_binary())


def decoded(ids: np.ndarray, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, the place where each begins, with the end)."""
    found = table.take(pa.array(ids, pa.uint32()))
    return np.frombuffer(found.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(ids) + 1]


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Places (but the ends) where texts can be cut and encoded apart: before a blank with an ASCII sign, letter or digit after it, behind
    one line break or tab between two of these, before an ASCII sign after an ASCII letter or digit, before a digit after a letter.

    Signs that an added token may hold (``<|>``) don't count, so no cut lies within one.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    kind = KINDS[data]
    a, b = kind[:-1], kind[1:]
    solid = (b == LETTER) | (b == DIGIT) | (b == SIGN) | (b == ODD)
    after_break = (a == BREAK) & solid
    after_break[1:] &= (a[:-1] == LETTER) | (a[:-1] == DIGIT) | (a[:-1] == SIGN)
    after_break[0] = False
    change = ((a == LETTER) | (a == DIGIT)) & (b == SIGN) | (a == LETTER) & (b == DIGIT)
    at = after_break | change
    at[:-1] |= (b[:-1] == BLANK) & solid[1:]
    return np.flatnonzero(at) + 1


LETTER, DIGIT, SIGN, ODD, BLANK, BREAK, OTHER = range(7)
KINDS = np.array([BLANK if b == 0x20 else BREAK if b in (9, 10, 13) else OTHER if b < 0x20 or b >= 0x7F else ODD if chr(b) in "<|>" else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256)], dtype=np.uint8)


def repaired(pieces: np.ndarray, piece_ends: np.ndarray, doc_ends: np.ndarray, table: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of each document) from the ids of pieces, which end at ``piece_ends`` (counted in ids), those of documents at ``doc_ends``.

    Each inner join gets a window from the second sure cut before it to the second one after it;
    overlapping windows are one. A window's ids must agree with the pieces' between its outer cuts;
    where they don't, it takes twice as many cuts on each side, at last the whole document.
    """
    data, starts = decoded(pieces, table)
    edges = starts[np.concatenate([[0], doc_ends])]
    cuts = np.union1d(sure_cuts(data), edges)
    joins = np.setdiff1d(starts[piece_ends], edges)
    out, reach = [], np.full(len(joins), 2)
    doc = np.searchsorted(edges, joins, side="right") - 1
    low, high = edges[doc], edges[doc + 1]
    windows: list[tuple[int, int]] = []
    done: dict[tuple[int, int], np.ndarray] = {}
    while len(joins):
        at = np.searchsorted(cuts, joins)  # the first cut at or behind the join
        left = np.maximum(cuts[np.maximum(at - reach, 0)], low)
        right = np.minimum(cuts[np.minimum(np.searchsorted(cuts, joins, side="right") + reach - 1, len(cuts) - 1)], high)
        apart = np.flatnonzero(np.concatenate([[True], left[1:] >= np.maximum.accumulate(right)[:-1]]))
        windows = list(zip(left[apart].tolist(), np.maximum.reduceat(right, apart).tolist(), strict=True))
        new = [w for w in windows if w not in done]
        ids, ends = encode(pa.array([data[a:b].tobytes().decode() for a, b in new], pa.large_string()))
        done |= {w: ids[ends[k] : ends[k + 1]] for k, w in enumerate(new)}
        bad = np.zeros(len(joins), dtype=bool)
        group = np.searchsorted(apart, np.arange(len(joins)), side="right") - 1
        for k, w in enumerate(windows):
            a, b = w
            own, (_, own_starts) = done[w], decoded(done[w], table)
            first, last = apart[k], apart[k + 1] - 1 if k + 1 < len(apart) else len(joins) - 1
            inner_left = cuts[np.searchsorted(cuts, a, side="right")]
            inner_right = cuts[np.searchsorted(cuts, b) - 1]
            fits = True
            if a < inner_left <= joins[first]:
                old = pieces[np.searchsorted(starts, a) : np.searchsorted(starts, inner_left)]
                fits &= np.array_equal(old, own[: np.searchsorted(own_starts, inner_left - a)])
            if joins[last] <= inner_right < b:
                old = pieces[np.searchsorted(starts, inner_right) : np.searchsorted(starts, b)]
                fits &= np.array_equal(old, own[np.searchsorted(own_starts, inner_right - a) :])
            if not fits:
                bad |= group == k
        if not bad.any() or ((left <= low) & (right >= high))[bad].all():
            break
        reach = np.where(bad, reach * 2, reach)
    at = 0
    spans = []
    for a, b in windows:
        i, j = int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b))
        spans.append((pieces[at:i], done[(a, b)]))
        at = j
    out = [x for pair in spans for x in pair] + [pieces[at:]]
    whole = np.concatenate(out).astype(np.uint32) if out else pieces
    _, whole_starts = decoded(whole, table)
    return whole, np.searchsorted(whole_starts, edges)


def results(ids: np.ndarray, ends: np.ndarray, table: pa.Array) -> list[pa.Array]:
    """n_tokens, ids_sha256, decoded_sha256 of each document."""
    data, starts = decoded(ids, table)
    raw, view = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8), memoryview(np.ascontiguousarray(data))
    spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    of_ids = [hashlib.sha256(memoryview(raw)[4 * a : 4 * b]).hexdigest() for a, b in spans]
    of_text = [hashlib.sha256(str(view[starts[a] : starts[b]], "utf-8", "replace").encode()).hexdigest() for a, b in spans]
    return [pa.array(np.diff(ends), pa.int64()), pa.array(of_ids), pa.array(of_text)]


PIECES = "text_digest binary, ord int, digest binary, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encoded_runs(known: Broadcast, tokenizer_path: str):
    """texts -> results of texts without a repeated chunk; of the others their pieces in order: a repeated chunk's digest, or the ids of a run of others.

    Of equal texts a task sends one for a while.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table, seen = encoder(tokenizer_path), bytes_of_ids(tokenizer_path), Seen()
        for batch in batches:
            for part in slices(batch, "text"):
                view, begins, cuts, hashes, first = chunked(part.column("text"))
                again = known.value.has(hashes)
                named, order, digests, runs, run_of = [], [], [], [], []
                for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    begin, end = (int(begins[lo]), int(cuts[hi - 1])) if hi > lo else (0, 0)
                    name = hashlib.sha256(view[begin:end]).digest()
                    if not seen.add(name):
                        continue
                    some = (np.flatnonzero(again[lo:hi]) + lo).tolist()
                    at, k = begin, 0
                    for c in [*some, None]:
                        upto = end if c is None else int(begins[c])
                        if upto > at or (c is None and not k):
                            named.append(name), order.append(k if some else -1), digests.append(None)
                            run_of.append(len(runs)), runs.append(bytes(view[at:upto]))
                            k += 1
                        if c is not None:
                            named.append(name), order.append(k), digests.append(digest(view[begins[c] : cuts[c]])), run_of.append(-1)
                            at, k = int(cuts[c]), k + 1
                ids, ends = enc.encode(pa.array(runs, pa.large_binary()).cast(pa.large_string()))
                values, run_of = binary_ids(ids, ends, stored_as(table)), np.array(run_of, dtype=np.int64)
                whole = np.array(order, dtype=np.int64) == -1
                n_tokens, of_ids, of_text = results(ids, ends, table)
                pick = lambda values, where: values.take(pa.array(run_of, pa.int64(), mask=~where))
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.binary()), pa.array(order, pa.int32()), pa.array(digests, pa.binary()), pick(values, (run_of >= 0) & ~whole), pick(n_tokens, whole), pick(of_ids, whole), pick(of_text, whole)], names=["text_digest", "ord", "digest", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


ASSEMBLED_BYTES = 4 << 20


def assembled(tokenizer_path: str):
    """(text_digest, ord, ids), in order and all of a text in one partition -> results; repeated pieces count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(tokenizer_path), bytes_of_ids(tokenizer_path)

        def finished(names: list[bytes], docs: list[list[bytes]]) -> pa.RecordBatch:
            kind = stored_as(table)
            sizes = [len(p) // kind.itemsize for doc in docs for p in doc]
            pieces = np.frombuffer(b"".join(p for doc in docs for p in doc), dtype=kind).astype(np.uint32)
            counts = np.cumsum([len(doc) for doc in docs])
            piece_ends = np.cumsum(sizes)
            ids, ends = repaired(pieces, piece_ends, piece_ends[counts - 1], table, enc.encode)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *results(ids, ends, table)], names=["text_digest", "n_tokens", "ids_sha256", "decoded_sha256"])

        names: list[bytes] = []
        docs: list[list[bytes]] = []
        last, held = -1, 0
        for batch in batches:
            for name, turn, ids in zip(batch.column("text_digest").to_pylist(), batch.column("ord").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if not names or names[-1] != name:
                    if held > ASSEMBLED_BYTES:
                        yield finished(names, docs)
                        names, docs, held = [], [], 0
                    names.append(name), docs.append([])
                    last = -1
                if turn != last:
                    docs[-1].append(ids)
                    last, held = turn, held + len(ids)
        if names:
            yield finished(names, docs)

    return run


def encoded_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, for a byte-level BPE tokenizer.

    A null text is the empty one (no ids). Repeated rows and null ids stay, each with its result; equal
    texts are pieced together once a task at most and joined back by their digest. Very long texts are
    read whole; one text's ids are the largest thing a task holds. An empty table gives an empty
    result. Other columns are ignored. Texts are read three times and stay in place; only repeated
    chunks' texts move, and the ids of texts that hold one.
    """
    enc = encoder(tokenizer_path)
    if enc.kind != "byte":
        raise ValueError("chunk reuse needs a byte-level BPE tokenizer without a prefix blank, cutting by its own pattern")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = staged(rows.mapInArrow(listed_chunks, "doc_id bigint, text_digest binary, chunks array<bigint>"), "chunk-lists")
    known = spark.sparkContext.broadcast(repeated_filter(listed))  # MOST_FILTER_BITS bits at most
    texts = rows.select("text")
    once = texts.mapInArrow(repeated_chunks(known), "digest binary, chunk string").dropDuplicates(["digest"])
    ids = staged(once.mapInArrow(encoded_chunks(tokenizer_path), "digest binary, ids binary"), "chunk-ids")
    parts = staged(texts.mapInArrow(encoded_runs(known, tokenizer_path), PIECES), "pieces")
    pieces = parts.where("ord >= 0").select("text_digest", "ord", "digest", "ids")
    looked_up = pieces.where("digest is not null").select("text_digest", "ord", "digest").join(ids, "digest").select("text_digest", "ord", "ids")
    every = looked_up.union(pieces.where("digest is null").select("text_digest", "ord", "ids"))
    joined = every.repartition("text_digest").sortWithinPartitions("text_digest", "ord").mapInArrow(assembled(tokenizer_path), "text_digest binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    whole = parts.where("ord = -1").select("text_digest", "n_tokens", "ids_sha256", "decoded_sha256").dropDuplicates(["text_digest"])  # empty texts, and those that a task met again much later
    found = staged(whole.union(joined), "encoded")  # a plain table, so that a group of equal texts is a skewed join that is split
    discard(ids, parts)
    return listed.select("doc_id", "text_digest").join(found, "text_digest").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
