"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from factloom.llm import importance
from factloom.llm.crc_spans import crc32_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_crc_of_short_and_long_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    lengths = np.array([*range(300), 4096, 4097, 8191, 250_000])
    starts = rng.integers(0, 40_000, len(lengths))
    assert crc32_spans(data, starts, lengths).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([r[1] for r in rows], target))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        f = features(text)
        gains = [math.floor(1000 * math.log((t[bucket(x)] + 1) * (ns + 10_000) / ((s[bucket(x)] + 1) * (nt + 10_000)))) for x in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    some = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(some[: 25 * len(some) // 100]):
        r[4] = k + 1
    return out


def run(spark, rows, target, parts=4):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, bucket int").repartition(parts)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    return [list(r) for r in importance.resampled(docs, bench).select("doc_id", "n_features", "weight", "score", "rank").collect()]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_equals_plain_python(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "ÉTÉ", "naïve", "字", "x" * 70, "y" * 200, "9lives", "A-B", " ", "don't", "\x7f", "ss", "ß"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "--", "\t ", "."]) for _ in range(n))
    rows = [(k, text(rng.randint(0, 60))) for k in range(120)] + [(200, None), (201, ""), (202, "..."), (203, "z" * 50_000), (None, text(30)), (5, text(25)), (204, text(5000))]
    target = [text(40), None, "alpha beta"]
    assert sorted(run(spark, rows, target), key=key) == sorted(plain(rows, target), key=key)


def test_equal_rows_are_drawn_each_for_itself(spark):
    rows = [(3, " ".join(["a"] * 20))] * 40 + [(4, " ".join(["a"] * 20))] * 40 + [(5, "few words")]
    got = run(spark, rows, [])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21))
    assert sorted(r[:4] for r in got) == sorted(r[:4] for r in plain(rows, []))
    best = max(r[3] for r in got if r[1] >= 39)
    assert all(r[3] == best for r in got if r[4])


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == []
    assert len(run(spark, [(1, "a b")], [])) == 1
