"""Hot groups, ties and outliers of the operators that deal rows by key."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import mixing, neighbours, ngram_join, shared, winnowing
from factloom.llm.components import components


def brute_taken(rows, targets):
    """(doc_id, size, taken) counts by a plain walk over each source in order of hash and tie."""
    out = []
    for source, (size, target) in targets.items():
        own = sorted((r.hash, r.tie, r.size, -1 if r.doc_id is None else r.doc_id) for r in rows if r.source == source)
        passes = int(target // size) if size else 0
        rest, before = target - passes * size, 0
        for _, _, n, doc in own:
            more = rest > 0 and (before + n <= rest or before <= rest and before + n - rest <= rest - before)
            out.append((doc, n, n * (passes + more)))
            before += n
    return sorted(out)


def test_mixing_of_repeated_ids_and_none(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(["w"] * n)
    rows = [(7, text(100 + i % 3), "a", i) for i in range(50)] + [(None, text(rng.randrange(40)), "b", i) for i in range(80)] + [(None, text(11), "b", i) for i in range(60)]
    rows += [(i, text(rng.randrange(90)), "c", i) for i in range(100)] + [(5, text(20), None, 1)] * 40 + [(6, None, "d", 0), (8, "", "d", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").withColumn("hash", F.lit(1)).withColumn("part", F.lit("x")).repartition(5)
    got = mixing.mix_sources(docs).collect()
    base = docs.select(*mixing.sized(docs, "mix", "doc_id", "text", "source")).collect()
    sizes = {}
    for r in base:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = {}
    for r in docs.select("source").distinct().collect():
        own = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 1.5, (5, 2, 1), 2.0)
        target = {x.source: (x.source_size, x.target) for x in own.collect()}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.taken) for r in got) == brute_taken(base, target)
    for source, (size, want) in target.items():
        near = sum(t for d, n, t in brute_taken([r for r in base if r.source == source], {source: (size, want)}))
        assert abs(near - want) <= 110
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)


def test_units_of_many_candidates_stay_small(spark):
    """Candidates that chain through shared hashes but don't link are verified by leader, not all against all."""
    m = 20_000
    pairs = spark.range(m).select(F.col("id").alias("node"), F.explode(F.array(F.col("id"), F.greatest(F.col("id") - 1, F.lit(0)))).alias("leader"), F.lit(100).cast("long").alias("n")).distinct()
    assert ngram_join.block_turns(pairs, 85, 100).count() <= 2 * m
    one = spark.range(3000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("leader"), (F.lit(10) + F.col("id")).alias("n"))
    turns = ngram_join.block_turns(one, 85, 100)
    met = turns.groupBy("leader", "low", "high").agg(F.collect_list(F.struct("node", "side", "n")).alias("s")).collect() if "n" in turns.columns else turns.join(one.select("node", "n"), "node").groupBy("low", "high").agg(F.collect_list(F.struct("node", "side")).alias("s")).collect()
    seen = set()
    for r in met:
        left = [x.node for x in r.s if x.side != 1]
        right = [x.node for x in r.s if x.side != 0]
        assert len(left) <= 2 * ngram_join.BLOCK
        for a in left:
            seen.update((min(a, b), max(a, b)) for b in right)
    want = {(a, b) for a in range(3000) for b in range(a + 1, 3000) if (10 + a) * 100 >= 85 * (10 + b)}
    assert want <= seen


def test_forest_links_what_brute_force_links():
    rng = np.random.default_rng(8)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 4000, rng.integers(5, 60))) for _ in range(6)]
        sets = []
        for _ in range(40):
            own = base[rng.integers(6)]
            keep = own[rng.random(len(own)) < rng.choice([1.0, 0.95, 0.7])]
            sets.append(np.unique(np.append(keep, rng.integers(0, 4000, rng.integers(0, 4)))))
        t = pa.table({"node": pa.array(range(40), pa.int64()), "side": pa.array([2] * 40, pa.int32()), "hashes": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
        got = ngram_join.forest(t, 85, 100)
        root = list(range(40))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        links = {(a, b) for a in range(40) for b in range(a + 1, 40) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
        found = {(min(a, b), max(a, b)) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)}
        assert found <= links
        for a, b in found:
            root[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in links)


def test_winnowing_buckets_are_even(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(10**15, "far")] + [(None, f"none {i % 3}") for i in range(2000)] + [(77, "same")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt = winnowing.with_next(docs, rows_a_bucket=200)
    sizes = [r["count"] for r in dealt.where("copy = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 20 and max(sizes) < 800
    assert dealt.where("copy = 1").count() == len(sizes)


def test_next_documents_across_buckets(spark, monkeypatch):
    rng = random.Random(2)
    ids = [rng.choice([None, 5, 5, 9, rng.randrange(-(10**17), 10**17)]) for _ in range(300)]
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(40))) for i in ids]
    monkeypatch.setattr(winnowing, "ROWS_A_BUCKET", 16)
    monkeypatch.setattr(winnowing.with_next, "__defaults__", (16,))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ties = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r]))
    want = sorted((-1 if a[0] is None else a[0], (a[1][:30] + b[1][:10])) for a, b in zip(order, order[1:] + order[:1], strict=True))
    import hashlib

    got = winnowing.fingerprints(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.edited_sha256) for r in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)
    hashes = lambda shown: {int(p, 16) >> 32 for p in shown.split()}
    for r in got:
        a, b = hashes(r.fingerprint), hashes(r.edited_fingerprint)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-12
    by_text = {}
    for r in got:
        by_text.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
    single = [(a, b) for a, b in zip(order, order[1:] + order[:1], strict=True) if len(by_text[-1 if a[0] is None else a[0]]) == 1 and len(by_text[-1 if b[0] is None else b[0]]) == 1]
    assert len(single) > 50
    for a, b in single:
        x, y = hashes(by_text[a[0]][0].fingerprint), hashes(by_text[b[0]][0].fingerprint)
        assert abs(by_text[a[0]][0].near_next - len(x & y) / len(x | y)) < 1e-12


def test_neighbour_blocks_are_skipped_with_one_hot_vector(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24)) * 3
    x = centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 24)) * 0.2
    x[1000:3000] = x[1000]
    df = spark.createDataFrame([(i, v.tolist(), "x", 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, block string, score double").repartition(6)
    index, _, _ = neighbours.build_index(df, block_rows=250)
    sizes = [len(r.ids) // 8 for r in index.select("ids").collect()]
    assert sum(sizes) == 6000 and max(sizes) < 700
    got = {}
    for r in neighbours.nearest(df, block_rows=250).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        kth = s[best[-1]]
        hits += sum(score >= kth - 1e-9 for _, _, score in found)
        total += 20
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
    assert len(got) == 300 and hits >= 0.9 * total


def test_components_of_a_hot_node(spark):
    e = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(e).where("label = 0").count() == 3000


def set_frames(spark, sets):
    """Units, sets and the sets by node, as the join has them: one unit of all."""
    rows = [(k + 1, sorted({int(x) for x in s})) for k, s in enumerate(sets)]
    units = shared.staged(spark.createDataFrame([(node, 7, len(h)) for node, h in rows], "node long, leader long, n long"), "units")
    return units, shared.staged(spark.createDataFrame(rows, "node long, hashes array<long>"), "whole-sets"), dict(rows)


def joined(spark, units, sets):
    by_pivot, turns = ngram_join.pivoted(units, sets, 85, 100)
    turns = shared.staged(turns, "turns")
    found = turns.join(sets, "node").select("leader", "part", "low", "high", "node", "side", "hashes").groupBy("leader", "part", "low", "high").applyInArrow(lambda t: ngram_join.forest(t, 85, 100), "a bigint, b bigint")
    links = found if by_pivot is None else found.union(by_pivot)
    return turns.count(), {r["node"]: r["label"] for r in components(links).collect()}


def labels(rows):
    """Components by all pairs."""
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    own = {k: set(v) for k, v in rows.items()}
    for a in rows:
        for b in rows:
            if a < b and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
    return {k: find(k) for k in rows}


def test_pivots_lose_no_link(spark, monkeypatch):
    """Templates at many distances from each other, chains between them, and sets that link with some linked sets only."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "PIVOTED", 20)
    rng = random.Random(9)
    sets = []
    for _ in range(3):
        base = rng.sample(range(4000), 60)
        for _ in range(30):
            drop = rng.randrange(0, 12)
            sets.append(base[drop:] + rng.sample(range(5000, 9000), rng.randrange(0, 8)))
        chain = list(base)
        for _ in range(25):  # each links with the one before, the ends don't
            chain = chain[3:] + rng.sample(range(9000, 20000), 3)
            sets.append(list(chain))
    rng.shuffle(sets)
    units, frames, rows = set_frames(spark, sets)
    _, got = joined(spark, units, frames)
    assert {k: got.get(k, k) for k in rows} == labels(rows)


def test_near_copies_of_templates_cost_about_their_number(spark):
    rng = np.random.default_rng(4)
    m, sets = 6000, []
    for t in range(2):
        base = np.arange(200) + 1000 * t
        for k in range(m // 2):
            own = base.copy()
            own[rng.integers(0, 200, 4)] = 10_000_000 + 1000 * (t * m + k) + np.arange(4)
            sets.append(own)
    units, frames, rows = set_frames(spark, sets)
    turns, got = joined(spark, units, frames)
    assert turns <= 2 * m  # in pairs of blocks each set would be in about 24 of them
    assert len(got) == m and len(set(got.values())) == 2
    assert ngram_join.block_turns(units, 85, 100).count() > 5 * m
