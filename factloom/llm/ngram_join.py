"""Exact Jaccard join on word n-grams, with set-relation skipping.

Linked sets of sizes a and b share at least 85 in 100 of the larger one. Three steps follow from it:

1. Of each set the least hashes are taken: so many that a linked pair must share a tenth of the
   smaller set's size among them. A set too few of whose least hashes occur in another set links
   with nothing. Equal sets are one node throughout.
2. The whole sets of those left are counted. A set with too few shared hashes goes. The rest, rarest
   hashes first, keep the shortest prefix in which a linked pair must meet. The least set that holds
   a hash in its prefix leads it, and the sets led by one leader are a unit: each pair that meets
   through a prefix is in some unit, and units don't chain. In a unit over ``PIVOTED`` sets each is first
   held against one of them, the pivot: those that link with it are one component and don't meet each
   other any more, and by the triangle inequality of Jaccard distances only sets within twice
   the distance of a link can link with them. So a group of M near copies costs about M. What doesn't link
   with the pivot gets the next one, while an eighth of the unit links with the last. Smaller units, where
   pairs of blocks are cheaper, and what is left are cut into bands of sizes, of which only neighbours
   can link, and blocks of ``BLOCK`` sets.
3. Units are verified in pairs of blocks. In a task the sets of one block are indexed: an index list
   is in order of size, cut by position into parts, and a set skips the parts whose sizes can't link
   before it reads a list. Sets that agree in their least hash follow each other, and the shared
   counts of one are derived from those of the one before by the hashes that came and went, when
   these are fewer. A task returns the links of a spanning forest, not all pairs.

Nothing is capped, and no hash is taken for rare that isn't: hot hashes are only counted
(partially aggregated) and joined back (a skewed join that is split), never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from factloom.llm.components import components
from factloom.llm.shared import discard, staged

MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]
BROADCAST_ROWS = 200_000
BLOCK, PART, PIVOTS, PIVOTED = 256, 64, 4, 4096


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's n-grams of words (A-Z lower-cased, ASCII white space between).

    With fewer than n words the whole sequence is the one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = mixed(total + h[i : len(h) - k + 1 + i] * np.uint64(MULTIPLIERS[i % 5]) + np.uint64(k))
    return np.unique((total >> np.uint64(1)).astype(np.int64))


def least_overlap(n, num: int, den: int):
    """What a set of n shares at least with any linked set: ceil(n * num / den)."""
    return -((-n * num) // den)


def infos(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, node, keys, mark, text_hash: the least hashes of each set that its task hasn't met before (else null)."""
    known, met = WordHashes(), set()
    for batch in batches:
        sizes, nodes, keys = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), n, known)
            sizes.append(len(s))
            node = xxh3_64_intdigest(s.tobytes()) >> 1 if len(s) else None
            nodes.append(node)
            if node is None or node in met:
                keys.append(None)
            else:
                met.add(node)
                keys.append(s[: len(s) - least_overlap(len(s), num, den) + -(-len(s) // 10)])
            if len(met) > 2_000_000:
                met.clear()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch.column("mark"), batch.column("text_hash")], names=["doc_id", "n_shingles", "node", "keys", "mark", "text_hash"])


def whole_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), n, known) for t in batch.column("text")]
        right = np.array([bool(len(s)) and xxh3_64_intdigest(s.tobytes()) >> 1 == node for s, node in zip(sets, batch.column("node").to_pylist(), strict=True)], dtype=bool)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"]).filter(pa.array(right, pa.bool_()))


def forest(t: pa.Table, num: int, den: int) -> pa.Table:
    """Links (a, b) of a spanning forest among the sets of two blocks (columns node, side, hashes)."""
    nodes = t.column("node").to_numpy()
    side = t.column("side").to_numpy()
    column = t.column("hashes").combine_chunks()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    size = np.diff(ends)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block with itself
    right = right[np.lexsort((nodes[right], size[right]))]
    token, at = np.unique(flat[ends[0] : ends[-1]], return_inverse=True)
    at = [at[ends[i] - ends[0] : ends[i + 1] - ends[0]] for i in range(len(nodes))]
    # the index: for each hash the places of sets that hold it, in order of size; a part is PART places
    spot = np.repeat(np.arange(len(right)), size[right])
    held = np.concatenate([at[i] for i in right]) if len(right) else np.zeros(0, np.int64)
    order = np.argsort(held, kind="stable")
    lists, starts = spot[order], np.searchsorted(held[order], np.arange(len(token) + 1))
    sizes = size[right]
    parts = [(a, min(a + PART, len(right))) for a in range(0, len(right), PART)]
    root = list(range(len(nodes)))
    key = np.repeat(np.arange(len(token), dtype=np.int64), np.diff(starts)) * (len(right) + 1) + lists  # ascending: a list's places are

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def shared(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the tokens the sets at places ``low`` to ``high`` hold; other parts of the lists are skipped."""
        first, last = np.searchsorted(key, tokens * (len(right) + 1) + low), np.searchsorted(key, tokens * (len(right) + 1) + high)
        n = last - first
        rows = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
        return np.bincount(lists[rows] - low, minlength=high - low)

    def reach(n: int) -> tuple[int, int]:
        """The places whose parts hold sizes that can link with ``n``."""
        fits = [(a, b) for a, b in parts if sizes[b - 1] * den >= n * num and n * den >= sizes[a] * num]
        return (fits[0][0], fits[-1][1]) if fits else (0, 0)

    links = []
    reaches = {int(n): reach(int(n)) for n in np.unique(size[left])}
    least = np.array([flat[ends[i]] if size[i] else 0 for i in left], dtype=np.int64)  # sets are sorted: the least hash
    last, counts, span = None, None, (0, 0)
    for i in left[np.lexsort((nodes[left], size[left], least))]:
        n = int(size[i])
        low, high = reaches[n]
        if low == high:
            continue
        if last is not None:
            gone, come = np.setdiff1d(at[last], at[i], assume_unique=True), np.setdiff1d(at[i], at[last], assume_unique=True)
        if last is None or (low, high) != span or len(gone) + len(come) >= n:
            counts = shared(at[i], low, high)
        else:
            counts = counts - shared(gone, low, high) + shared(come, low, high)
        last, span = i, (low, high)
        for j in right[low:high][counts * den >= (n + sizes[low:high] - counts) * num]:
            x, y = find(int(i)), find(int(j))
            if x != y:
                root[x] = y
                links.append((int(nodes[i]), int(nodes[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def ceil_share(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * F.lit(num) / F.lit(den)).cast("long")


def block_turns(members: DataFrame, num: int, den: int) -> DataFrame:
    """node, leader, low, high, side: the pairs of blocks (band, block) in which each set of a unit is verified.

    ``members`` is a written table of node, leader and n, the set's size. The sizes of linked sets
    differ by one band at most; a unit of up to ``BLOCK`` sets is one block.
    """
    width = log(den / num) * 1.001 if num < den else 1e-9
    big = staged(members.groupBy("leader").agg(F.count("*").alias("_k")).where(F.col("_k") > BLOCK).select("leader"), "big-units")
    few = F.broadcast if big.count() <= BROADCAST_ROWS // 50 else lambda df: df  # a unit has some dozens of bands
    whole = F.struct(F.lit(0).cast("long").alias("band"), F.lit(0).alias("block"))
    small = members.join(few(big), "leader", "left_anti").select("node", "leader", whole.alias("low"), whole.alias("high"), F.lit(2).alias("side"))
    banded = members.join(few(big), "leader", "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long"))
    amount = banded.groupBy("leader", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    beside = amount.select("leader", "band", "blocks", F.lit(0).alias("up"), F.lit(0).alias("down"))
    beside = beside.union(amount.select("leader", F.col("band") - 1, F.lit(0), "blocks", F.lit(0))).union(amount.select("leader", F.col("band") + 1, F.lit(0), F.lit(0), "blocks"))
    beside = beside.groupBy("leader", "band").agg(F.sum("blocks").cast("int").alias("blocks"), F.sum("up").cast("int").alias("up"), F.sum("down").cast("int").alias("down")).where("blocks > 0")
    placed = banded.join(few(staged(beside, "bands")), ["leader", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def place(band: Column, block: Column) -> Column:
        return F.struct(band.cast("long").alias("band"), block.cast("int").alias("block"))

    band, block = F.col("band"), F.col("block")
    same = F.transform(numbers(F.col("blocks")), lambda o: F.struct(place(band, F.least(block, o)).alias("low"), place(band, F.greatest(block, o)).alias("high"), F.when(o == block, 2).when(block < o, 0).otherwise(1).alias("side")))
    above = F.transform(numbers(F.col("up")), lambda o: F.struct(place(band, block).alias("low"), place(band + 1, o).alias("high"), F.lit(0).alias("side")))
    under = F.transform(numbers(F.col("down")), lambda o: F.struct(place(band - 1, o).alias("low"), place(band, block).alias("high"), F.lit(1).alias("side")))
    return small.union(placed.select("node", "leader", F.explode(F.concat(same, above, under)).alias("_turn")).select("node", "leader", "_turn.low", "_turn.high", "_turn.side"))


def crossing_turns(placed: DataFrame, num: int, den: int) -> DataFrame:
    """node, leader, low, high, side: the pairs of a block of linked sets and a block of near ones of the same or a neighbouring band.

    ``placed`` is a written table of node, leader, n and linked. Units with sets of one kind only have no pairs.
    """
    width = log(den / num) * 1.001 if num < den else 1e-9
    both = placed.groupBy("leader").agg(F.max("linked").alias("some"), F.min("linked").alias("all")).where("some and not all").select("leader")
    banded = staged(placed.join(both, "leader", "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")), "crossing")
    amount = banded.groupBy("leader", "band", "linked").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    around = F.explode(F.array(*(F.struct((F.col("band") + by).alias("band"), F.lit(-by).alias("by")) for by in (-1, 0, 1))))
    offers = amount.select("leader", (~F.col("linked")).alias("linked"), "blocks", around.alias("x")).select("leader", "linked", "x.band", "x.by", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    own = banded.join(amount.select("leader", "band", "linked", "blocks"), ["leader", "band", "linked"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    place = lambda band, block: F.struct(band.cast("long").alias("band"), block.cast("int").alias("block"))
    offers = staged(offers.groupBy("leader", "band", "linked").agg(F.collect_list(place(F.col("band") + F.col("by"), F.col("other"))).alias("others")), "crossing-blocks")  # the blocks of three bands
    met = own.join(offers, ["leader", "band", "linked"]).select("node", "leader", "linked", place(F.col("band"), F.col("block")).alias("me"), F.explode("others").alias("other"))
    return met.select("node", "leader", F.when(F.col("linked"), F.col("me")).otherwise(F.col("other")).alias("low"), F.when(F.col("linked"), F.col("other")).otherwise(F.col("me")).alias("high"), F.when(F.col("linked"), 0).otherwise(1).alias("side"))


def pivoted(members: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame | None, DataFrame]:
    """(links (a, b) with pivots; node, leader, part, low, high, side: what is left to verify in blocks).

    ``members``: node, leader, n; ``sets``: node, hashes; both written tables.
    Linked sets differ by at most 1 - num / den in distance, a metric, so what links with a set that
    the pivot links with lies within twice that of the pivot.
    """
    names = ["node", "leader", "part", "low", "high", "side"]
    links, turns, left = None, [], [members]
    for k in range(PIVOTS):
        sizes = members.groupBy("leader").agg(F.count("*").alias("_k"), F.min("node").alias("pivot"))
        big = staged(sizes.where(F.col("_k") > (PIVOTED if k == 0 else BLOCK)), "big-units")
        left[-1] = members.join(big, "leader", "left_anti").select("node", "leader", "n")
        if big.isEmpty():
            break
        heads = big.select("pivot").distinct().join(sets, F.col("pivot") == F.col("node")).select("pivot", F.col("hashes").alias("head"))
        inside = members.join(big, "leader").join(sets, "node").join(heads, "pivot")
        shared, of = F.size(F.array_intersect("hashes", "head")).cast("long"), F.size("head").cast("long")
        inside = inside.select("node", "leader", "n", "pivot", "_k", shared.alias("shared"), (F.col("n") + of - shared).alias("union"))
        linked = F.col("shared") * den >= F.col("union") * num
        near = F.col("shared") * den >= F.col("union") * (2 * num - den)
        placed = staged(inside.select("node", "leader", "n", "pivot", "_k", linked.alias("linked"), near.alias("near")), "pivoted")
        found = placed.where("linked and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        links = found if links is None else links.union(found)
        turns.append(crossing_turns(placed.where("near").select("node", "leader", "n", "linked"), num, den).withColumn("part", F.lit(k)).select(*names))
        useful = placed.groupBy("leader").agg((F.count(F.when(F.col("linked"), 1)) * 8 >= F.max("_k")).alias("_useful")).where("_useful").select("leader")
        rest = placed.where("not linked").select("node", "leader", "n")
        left += [rest.join(useful, "leader", "left_anti"), None]
        members = left[-1] = staged(rest.join(useful, "leader", "left_semi"), "unpivoted")
    rest = left[0]
    for more in left[1:]:
        rest = rest.unionByName(more)  # joins put their key first
    turns.append(block_turns(staged(rest, "blocked"), num, den).withColumn("part", F.lit(PIVOTS)).select(*names))
    out = turns[0]
    for t in turns[1:]:
        out = out.union(t)
    return links, out


def jaccard_links(docs: DataFrame, *, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node, mark of each row; links (a, b) between nodes that connect just what is linked). ``mark``: a long to tell rows apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), (F.lit(0).cast("long") if mark is None else mark).alias("mark"))
    info = staged(rows.mapInArrow(lambda b: infos(b, n, num, den), "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>, mark bigint, text_hash bigint"), "sets")
    keys = info.where(F.col("keys").isNotNull()).select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
    met = keys.join(shared, "key").groupBy("node").agg(F.count_distinct("key").alias("met"))
    reps = info.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"), F.max("n_shingles").alias("n"))
    need = F.ceil(ceil_share(F.col("n"), num, den) / 10)
    live = staged(met.join(reps, "node").where(F.col("met") >= need).select("node", "rep", "n"), "live-sets")
    few = live.count() <= BROADCAST_ROWS
    wanted = live.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    joined = rows.join(F.broadcast(wanted) if few else wanted, (rows["text_hash"] == wanted["rep_hash"]) & rows["doc_id"].eqNullSafe(wanted["rep_id"])).select("node", "text")
    sets = staged(joined.mapInArrow(lambda b: whole_sets(b, n), "node bigint, hashes array<bigint>").dropDuplicates(["node"]), "whole-sets")
    held = sets.select("node", F.explode("hashes").alias("key"))
    counts = held.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(counts, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("own"))
    ranked = ranked.join(live.select("node", "n"), "node").where(F.size("own") >= ceil_share(F.col("n"), num, den))
    prefix = F.slice("own", F.lit(1), (F.size("own") - ceil_share(F.col("n"), num, den) + 1).cast("int"))
    meets = staged(ranked.select("node", F.explode(F.transform(prefix, lambda s: s["key"])).alias("key")), "prefixes")
    least = meets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("leader < most").select("key", "leader")
    members = meets.join(least, "key").select("node", "leader").distinct().join(live.select("node", "n"), "node")
    units = staged(members, "units")
    by_pivot, turns = pivoted(units, sets, num, den)
    found = turns.join(sets, "node").select("leader", "part", "low", "high", "node", "side", "hashes")
    links = found.groupBy("leader", "part", "low", "high").applyInArrow(lambda t: forest(t, num, den), "a bigint, b bigint")
    links = staged(links if by_pivot is None else links.union(by_pivot), "links")
    discard(live, sets, meets, units)
    return info.select("doc_id", "n_shingles", "node", "mark"), links


def jaccard_components(docs: DataFrame, *, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, its own included.

    Null and empty texts have no shingles and are components of their own. A row without an id
    takes the smallest id of its component (null if that has none). Repeated rows stay, rows that repeat an id count each by its own text. Very long texts are taken whole. An empty
    table gives an empty result; other columns are ignored, whatever their names. Sets count as equal by 63 bits of hash.
    """
    info, links = jaccard_links(docs, n=n, num=num, den=den, id_col=id_col, text_col=text_col)
    labels = components(links)
    ids = info.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = ids.groupBy("label").agg(F.min("least").alias("component_id"))
    final = ids.join(best, "label").select(F.col("node").alias("_node"), "component_id")
    out = info.join(final, info["node"] == final["_node"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, *, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one of the smallest id, rows without an id last.

    Among rows of one id, or without one, that of the least hash over all columns stays, and of
    wholly equal rows one. Null and empty texts are components of their own: all their rows stay.
    """
    every = [F.col(c).isNull() for c in docs.columns] + [F.col(c) for c in docs.columns]
    mark = F.xxhash64(*every)
    info, links = jaccard_links(docs, n=n, num=num, den=den, id_col=id_col, text_col=text_col, mark=mark)
    rows = info.where(F.col("node").isNotNull()).groupBy("node", "doc_id", "mark").agg(F.count("*").alias("copies"))
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "copies")).alias("row"))
    first = first.join(components(links), "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("row").alias("row"))
    alone = info.where(F.col("node").isNull()).select("doc_id", "mark", F.lit(False).alias("repeated")).distinct()
    kept = first.select("row.doc_id", "row.mark", (F.col("row.copies") > 1).alias("repeated")).union(alone)
    kept = staged(kept.select(F.col("doc_id").alias("_kept"), F.col("mark").alias("_mark"), "repeated"), "kept")
    few = kept.count() <= BROADCAST_ROWS

    def held(keys: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(keys) if few else keys, docs[id_col].cast("long").eqNullSafe(keys["_kept"]) & (mark == keys["_mark"]), "left_semi")

    again = kept.where("repeated")
    once = held(kept.where("not repeated"))
    return once if again.isEmpty() else once.union(held(again).dropDuplicates())
