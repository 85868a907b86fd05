"""Very long texts, clashing names, nulls and empty tables of operators whose other tests have none."""

import hashlib
import random

from pyspark.sql import functions as F

from factloom.llm import html_text, mixing, ngram_join, winnowing


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = " ".join(f"w{rng.randrange(40_000)}" for _ in range(60_000))
    docs = spark.createDataFrame([(1, words, "a"), (2, words.upper(), "a"), (3, words[: len(words) // 2], "b"), (4, "w1 w2", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3) and got[1].n_shingles > 50_000
    sizes = {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert sizes == {1: 60_000, 2: 60_000, 3: len(words[: len(words) // 2].split()), 4: 2}
    text = words[:120_000]
    pair = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    out = {r.doc_id: r for r in winnowing.fingerprints(pair).collect()}
    edited = text[: len(text) - len(text) // 4] + "short"
    assert out[1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[1].n_chars == 120_000
    assert 0.6 < out[1].near_edited < 0.9


def test_pages_with_clashing_columns(spark):
    page = "<body><div class=story><h1>T{0}</h1><p>{1}</p></div><div class=x><p>y{0}</p></div></body>"
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(["amber", "birch", "cedar", "delta"]) for _ in range(50))
    rows = [(k, "https://h.org/" + str(k), page.format(k, prose())) for k in range(9)] + [(None, None, None), (4, "https://h.org/4", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "rule", "text", "n_chars", "wrapper", "_salt"):
        pages = pages.withColumn(name, F.lit(name))
    got = html_text.main_texts(pages).collect()
    assert len(got) == 11 and sorted(r.text.split("\n")[0] for r in got) == ["", "", *(f"T{k}" for k in range(9))]
    assert all("y" not in r.text for r in got)
