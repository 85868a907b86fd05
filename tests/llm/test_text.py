import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest  # noqa: F401  the library hashes with it

from factloom.llm import html_text, mixing, neighbours, ngram_join, quality, toxicity, winnowing
from factloom.llm.components import components


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, node long")


def drawn(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(n):
        if k and rng.random() < 0.5:
            own = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 90, 200]))]
        texts.append(" ".join(own))
    return texts


def brute_components(texts, n, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "block"), [(4, 85, 256), (5, 80, 8), (2, 60, 8)])
def test_jaccard_components(spark, monkeypatch, n, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = list(enumerate([*drawn(n, 120), "A b C d", "a B c d", "", None]))
    docs = documents(spark, [(i, t, "en", "s", 0, "x", 1) for i, t in texts])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, n=n, num=num).collect()}
    want = brute_components(texts, n, num, 100)
    assert got == want
    kept = {r.doc_id for r in ngram_join.distinct_documents(docs, n=n, num=num).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_of_nothing(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0
    got = ngram_join.jaccard_components(documents(spark, [(None, "a b c d e", "", "", 0, "", 0), (7, "a b c d e", "", "", 0, "", 0), (7, "a b c d e", "", "", 0, "", 0), (None, None, "", "", 0, "", 0)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in components(e).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}


def brute_picks(text, hashes, k, w):
    n = len(text)
    if n < k:
        return [(0, hashes(text))] if n else []
    h = [hashes(text[i : i + k]) for i in range(n - k + 1)]
    out = []
    for a in range(max(1, len(h) - w + 1)):
        own = h[a : a + w]
        at = a + max(i for i, x in enumerate(own) if x == min(own))
        if (at, h[at]) not in out:
            out.append((at, h[at]))
    return out


def test_winnowing_picks_least_rightmost(spark):
    texts = ["", "ab", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog 🙂 again and again", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", winnowing.fingerprint(F.col("t"), 4, 8).alias("f"))
    for t, f in df.collect():
        got = [(winnowing.TOP - (p & 0xFFFFFFFF), p >> 32) for p in f]
        if len(t) >= 4:
            grams = {t[i : i + 4]: None for i in range(len(t) - 3)}
            chain = spark.createDataFrame([(g,) for g in grams], "g string").select("g", winnowing.fingerprint(F.col("g"), 4, 8)[0].alias("p")).collect()
            table = {g: p >> 32 for g, p in chain}
            assert got == brute_picks(t, table.__getitem__, 4, 8)
        else:
            assert len(got) == bool(t)


def test_winnowing_query(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc déf") for _ in range(rng.choice([0, 3, 20, 60, 400]))) for _ in range(60)] + [None, "🙂" * 50]
    docs = documents(spark, [(3 * i - 7, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in winnowing.fingerprints(docs).collect()}
    own = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + own[(i + 1) % len(own)][: len(t) // 4] for i, t in enumerate(own)]
    plain = spark.createDataFrame([(3 * i - 7, e) for i, e in enumerate(edited)], "doc_id long, e string").select("doc_id", winnowing.shown(winnowing.fingerprint(F.col("e"))).alias("f"))
    for r in plain.collect():
        assert got[r.doc_id].edited_fingerprint == r.f
    for i, t in enumerate(own):
        r = got[3 * i - 7]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert winnowing.fingerprints(docs.limit(0)).count() == 0
    lone = winnowing.fingerprints(docs.limit(1)).first()
    assert lone.near_next == 1.0


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(60)) if i % 17 else None, "en", rng.choice(["a", "b", "c", "d", None]), 0, "x", 1) for i in range(400)]
    docs = documents(spark, [*rows, rows[3], (None, "x y", "en", "a", 0, "x", 1)])
    got = mixing.mix_sources(docs).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
    for r in docs.join(mixing.mix_sources(docs), "doc_id").select("source", "source_size", "target").distinct().collect():
        by[r.source] = r
    assert abs(sum(r.target for r in by.values()) - 1.5 * total) < 1e-6 * total
    for s, r in by.items():
        assert r.target <= 2 * r.source_size + 1e-9
        taken = sum(x.taken for x in mixing.mix_sources(docs.where(F.col("source").eqNullSafe(F.lit(s))), share=r.target / r.source_size).collect())
        assert abs(taken - r.target) <= 120
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16)) * rng.uniform(0.5, 2, (1200, 1))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 3), (2080, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, block_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    hits = 0
    assert set(got) == set(range(0, 1200, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hits += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 20 and all(abs(score - s[v]) < 1e-9 for v, score in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 20 * len(got)
    assert [r.vec_id for r in neighbours.nearest(df.where("vec_id in (0, 1)")).collect()] == [1]
    assert neighbours.nearest(df.limit(0)).count() == 0


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a>More</a></ul></nav><div class=ad>Buy {n}</div><article><h1>Title {n}</h1><p>One &amp; {n}<br>two<p><b>Three</b>  \n four</p><ul><li>x<li>y</ul></article><div id=comments><p>bad</p></div><footer>&copy; host</footer>"


def test_html(spark):
    rows = [(k, f"https://h{k % 3}.org/{k}", PAGE.replace("{n}", str(k))) for k in range(40)] + [(90, None, "<p>a<p>b"), (91, "https://h0.org/x", "plain <b>text</b>"), (92, "x", None), (93, "x", ""), (None, "https://h1.org/y", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r for r in html_text.main_texts(pages).collect()}
    for k in range(40):
        assert got[k].text == f"Title {k}\nOne & {k} two\nThree four\nx\ny" and got[k].n_chars == len(got[k].text)
    assert (got[90].text, got[91].text, got[92].text, got[93].text) == ("a\nb", "plain text", "", "")
    assert html_text.main_texts(pages.limit(0)).count() == 0
    many = html_text.infer_wrappers(pages, fan_in=2)
    assert many.count() == many.select("host").distinct().count()
    shown = html_text.expression(__import__("json").loads(many.where("host = 'h1.org'").first().wrapper))
    assert "#text" in shown and ")+" in shown


def test_wrapper_alignment():
    a, b = (html_text.wrapper_of(html_text.parsed(x)) for x in ("<div><h2>Same</h2><p>one</p><p>two</p></div>", "<div><h2>Same</h2><i>note</i><p>three</p></div>"))
    assert html_text.expression(html_text.aligned(a, b)) == "<div><h2>Same</h2> ( <i>note</i> )? ( <p>#text</p> )+</div>"
    assert html_text.main_text("<div>" * 3000 + "deep", None) == "deep"


def labelled(spark, n=900):
    rng = random.Random(9)
    good = ["river", "stone", "maple", "cloud", "early", "bridge", "window", "garden"]
    rows, labels = [], []
    for i in range(n):
        low, bad = rng.random() < 0.3, rng.random() < 0.3
        words = [rng.choice(good) for _ in range(rng.randrange(20, 60))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vilely", "vilest", "grimbo"])
        own = " ".join(w.upper() + "!!" for w in words) if low else ". ".join([" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8)])
        rows.append((i, own, rng.choice(["en", "de"]), "s", len(own), "x", 1))
        labels.append((i, int(not low), int(bad)))
    rows += [(None, "x", None, None, 0, "x", 1), (n + 1, None, "en", "s", 0, "x", 1), (n + 2, "word " * 60_000, "en", "s", 0, "x", 1)]
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_hold_out(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("quality is not null").collect()}
    q = {r.doc_id: r for r in quality.quality_scores(docs, quality.train(docs, labels)).collect()}
    t = {r.doc_id: r for r in toxicity.toxicity_scores(docs, toxicity.train(docs, labels, most=700)).collect()}
    assert len(q) == len(t) == docs.count()
    for got, mod, left, label, least in ((q, 3, 1, "quality", 0.97), (t, 4, 2, "toxic", 0.93)):
        held = [i for i in range(900) if zlib.crc32(str(i).encode()) % mod == left]
        assert all(got[i].held_out == (i in set(held)) for i in range(900))
        assert np.mean([got[i].predicted == truth[i][label] for i in held]) >= least
        assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.quality_scores(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_tables_are_sums_of_bins():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(np.hstack([x, np.zeros((600, len(quality.FEATURES) - 3))]), y)
    assert (0, 1) in model.pairs
    got = model.score(np.hstack([x, np.zeros((600, len(quality.FEATURES) - 3))]))
    assert ((got >= 0.5) == y).mean() > 0.8


def test_long_texts_are_scored_whole():
    """A text of many parts scores as a short one with the same runs of words, wherever they stand."""
    net = toxicity.fit(["good words here", "bad grimbo here"] * 20, np.array([0.0, 1.0] * 20), epochs=20)
    run = "good words here "
    short = net.score([run * 3, run * 3 + "grimbo", run * 2 + "bad grimbo here " + run])
    long = net.score([run * 40_000, run * 40_000 + "grimbo", run * 20_000 + "bad grimbo here " + run * 20_000])
    assert np.allclose(short, long)
    assert short[0] < short[1] and short[0] < 0.5 < short[2]
