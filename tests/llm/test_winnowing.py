"""Likenesses of whole fingerprints against plain Python, whose only help is the hash of a single k-gram."""

import random

from pyspark.sql import functions as F

from factloom.llm import winnowing

K, W = winnowing.K, winnowing.W


def plain_hashes(text, hash_of):
    """Hashes that windows of neighbouring k-grams pick; the whole text's where it is shorter than k."""
    if len(text) < K:
        return {hash_of[text]} if text else set()
    own = [hash_of[text[i : i + K]] for i in range(len(text) - K + 1)]
    return {min(own[i : i + W]) for i in range(max(1, len(own) - W + 1))}


def test_likenesses_equal_plain_python(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abc déf") for _ in range(300))
    texts = [base, base[:250] + "x" * 40, base[100:], "".join(rng.choice("ab") for _ in range(90)), "", None, "short", "a" * 15, "b" * 16, "🙂" * 60, base, base]
    ids = [3, 8, 9, 11, 20, 21, 22, 23, 40, 41, 42, 42]
    rows = list(zip(ids, texts, strict=True))
    rng.shuffle(rows)
    own = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + own[(i + 1) % len(own)][: len(t) // 4] for i, t in enumerate(own)]
    grams = sorted({t[i : i + K] for t in own + edited for i in range(max(1, len(t) - K + 1))} - {""})
    table = {r.g: r.h for r in spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.shiftright(winnowing.fingerprint(F.col("g"))[0], 32).alias("h")).collect()}
    sets = [[plain_hashes(t, table) for t in part] for part in (own, edited)]

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    want = sorted((i, len(t), like(sets[0][k], sets[1][k]), like(sets[0][k], sets[0][(k + 1) % len(own)])) for k, (i, t) in enumerate(zip(ids, own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in winnowing.fingerprints(docs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[k] - w[k]) < 1e-12 for g, w in zip(got, want) for k in (2, 3))
    assert 0.5 < got[0][2] < 1 and got[0][3] > 0.5


def test_row_numbers_are_made_once(spark):
    """A source whose rows come in another order each time: every row still finds its next one."""
    docs = spark.range(400).select((F.col("id") % 7).alias("doc_id"), F.concat(F.lit("text of the row "), F.col("id").cast("string")).alias("text")).repartition(5).orderBy(F.rand())
    got = winnowing.with_next(docs, rows_a_bucket=20)
    rows = got.where("copy = 0").collect()
    assert len(rows) == 400 and len({r.row for r in rows}) == 400
    buckets = {r.bucket for r in rows}
    assert got.where("copy = 1").count() == len(buckets) > 5


def test_grams_are_cut_from_four_bytes_a_code_point(spark):
    """A k-gram is hashed at once, from its bytes at a known place, not from hashes of single code points."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é🙂\ufeff\x00") for _ in range(n)) for n in (15, 16, 17, 46, 47, 48, 200)]
    grams = sorted({t[i : i + K] for t in texts for i in range(len(t) - K + 1)})
    rows = spark.createDataFrame([(g, g.encode("utf-32-be")) for g in grams], "g string, b binary")
    table = {r.g: r.h & winnowing.TOP for r in rows.select("g", F.shiftright(F.xxhash64("b"), 32).alias("h")).collect()}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", winnowing.fingerprint(F.col("t")).alias("f"))
    for t, f in got.collect():
        picks = []
        for i in range(max(1, len(t) - K - W + 2) if len(t) >= K else 0):
            hashes = [table[t[j : j + K]] for j in range(i, min(i + W, len(t) - K + 1))]
            pick = (min(hashes), i + max(j for j, h in enumerate(hashes) if h == min(hashes)))
            picks += [pick] if pick not in picks else []
        assert len(t) < K or [(p >> 32, winnowing.TOP - (p & 0xFFFFFFFF)) for p in f] == picks
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("xxhash64(") == 2
