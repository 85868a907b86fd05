import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import labelled, quality, toxicity


def test_places_are_filled_and_repeats_are_one(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i % 7}", "y", "en") for i in range(2000)] + [(None, "x", "y", "en")], "doc_id long, text string, y string, _id string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(7)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got, weights = labelled.labelled_sample(docs, labels, "toxic", 4, 99, 6, {"text": F.col("text")})
    rows = labelled.one_each(got).collect()
    assert len(rows) == 6 and sum(r.y for r in rows) == 1 and len({r._id for r in rows}) == 6
    assert abs(weights[1] * 1 + weights[0] * 5 - 6) < 1e-9 and abs(weights[0] / weights[1] - 6 / 5) < 1e-9
    none, _ = labelled.labelled_sample(docs, labels.limit(0), "toxic", 4, 99, 6, {"text": F.col("text")})
    assert none.count() == 0


def test_labels_without_a_document_take_no_place(spark):
    docs = spark.createDataFrame([(i * 10, "x" * (40_000 if i % 4 == 1 else 5)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 60 == 0)) for i in range(800)], "doc_id long, toxic int")
    got, weights = labelled.labelled_sample(docs, labels, "toxic", 4, 99, 60, {"text": F.col("text")})
    rows = got.collect()
    ones = sum(r.y for r in rows)
    assert len(rows) == 60 and ones == 14  # of 80 labelled documents, 14 of class 1
    assert abs(weights[1] * 14 + weights[0] * 46 - 60) < 1e-9 and abs(weights[1] / weights[0] - (14 / 14) / (66 / 46)) < 1e-9
    short = docs.where(F.length("text") < 100)
    assert labelled.labelled_sample(short, labels, "toxic", 4, 99, 55, {"text": F.col("text")})[0].count() == 55


def test_bounded_samples_keep_the_classes_shares():
    rng = np.random.default_rng(4)
    x = np.hstack([rng.normal(size=(4000, 1)), np.zeros((4000, len(quality.FEATURES) - 1))])
    y = (rng.random(4000) < 1 / (1 + np.exp(-x[:, 0] + 2))).astype(float)
    whole = quality.fit(x, y)
    part = np.concatenate([np.flatnonzero(y == 1)[:300], np.flatnonzero(y == 0)[:300]])
    share = 600 / 4000
    w = {1: (y == 1).sum() / 300 * share, 0: (y == 0).sum() / 300 * share}
    weighed = quality.fit(x[part], y[part], np.where(y[part] > 0, w[1], w[0]))
    plain = quality.fit(x[part], y[part])
    off = [abs(m.score(x).mean() - whole.score(x).mean()) for m in (weighed, plain)]
    assert off[0] < 0.05 < off[1]


def test_filters_keep_clashing_columns(spark, monkeypatch):
    rows = [(i, "bad grimbo here" if i % 3 == 0 else "Good words. They stand here.", None if i % 2 else "en", i, 0.5, True, 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y long, score double, held_out boolean, predicted int")
    docs = docs.withColumn("lang_threshold", F.lit(1)).withColumn("_row", F.lit("r")).withColumn("_text", F.lit("t"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: labels)
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_toxic):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r.y for r in out.collect()} <= set(range(60))
    assert quality.quality_scores(docs, quality.train(docs, labels)).count() == 60
    net = toxicity.train(docs, labels)
    net.thresholds = {"": 0.0, "en": 2.0}
    cuts = {(r.doc_id % 2, r.lang_threshold) for r in toxicity.toxicity_scores(docs, net).collect()}
    assert cuts == {(0, 2.0), (1, 0.0)}
    assert {r.doc_id % 2 for r in toxicity.passed(docs, net).collect()} == {0}


def test_scores_equal_the_models_own(spark):
    texts = [None, "", "plain words", "word " * 70_000, "Ünï çode 🙂", "grimbo"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang string")
    rng = np.random.default_rng(1)
    x = np.array([quality.features(t) for t in texts])
    model = quality.fit(np.repeat(x, 20, axis=0), rng.integers(0, 2, 120).astype(float))
    net = toxicity.fit(texts[2:] * 10, np.array([0.0, 0, 0, 1] * 10), epochs=2)
    q = {(r.doc_id, r.score) for r in quality.quality_scores(docs, model).collect()}
    assert q == {(i, s) for i, s in enumerate(model.score(x).tolist())}
    t = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, net).collect()}
    plain = net.score_rows([toxicity.word_rows(text, toxicity.ROWS) for text in texts])
    assert all(abs(t[i] - plain[i]) < 1e-6 for i in range(len(texts)))
