"""Each stage of the pipeline against a plain version of itself, on what the stage before it kept."""

import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import mixing, quality, toxicity
from factloom.llm.shared import staged
from tests.llm.test_hot import brute_taken
from tests.llm.test_text import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    model = quality.train(docs, labels)
    kept = staged(stages["quality"](spark, docs, SF), "t").collect()
    assert sorted(kept) == sorted(r for r in rows if model.score(quality.np.array([quality.features(r.text)]))[0] >= 0.5)

    docs = staged(spark.createDataFrame(kept, docs.schema), "t")
    net = toxicity.train(docs, labels)
    clean = staged(stages["toxicity"](spark, docs, SF), "t").collect()
    assert sorted(clean) == sorted(r for r in kept if net.score([r.text])[0] < net.thresholds.get(r.lang or "", 0.3))

    docs = staged(spark.createDataFrame(clean, docs.schema), "t")
    single = staged(stages["near_copies"](spark, docs, SF), "t").collect()
    groups = brute_components([(r.doc_id, r.text) for r in clean], 5, 80, 100)
    assert {r.doc_id for r in single} == {i for i, (_, least) in groups.items() if i == least} and len(single) == len({r.doc_id for r in single})

    docs = staged(spark.createDataFrame(single, docs.schema), "t")
    mixed = staged(stages["mixing"](spark, docs, SF), "t").collect()
    base = docs.select(*mixing.sized(docs, "mix", "doc_id", "text", "source")).collect()
    sizes = {}
    for r in base:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 1.5, (5, 2, 1), 2.0).collect()
    want = {i: taken // size for i, size, taken in brute_taken(base, {r.source: (r.source_size, r.target) for r in targets}) if size}
    got = dict.fromkeys(want, 0)
    for r in mixed:
        got[r.doc_id] += 1
    assert got == want

    docs = staged(spark.createDataFrame(mixed, docs.schema), "t")
    pieces = stages["packing"](spark, docs, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for r in mixed:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        head = len(ids) - (len(ids) - 1) // 1024 * 1024
        for k, (a, b) in enumerate([(0, head), *((s, s + 1024) for s in range(head, len(ids), 1024))]):
            expected.append((r.doc_id, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(expected)
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_registered_queries_against_plain_versions(spark):
    """The classifiers' queries by their registered names: folds and scores of every row."""
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model, net = quality.train(docs, labels), toxicity.train(docs, labels)
    for name, mod, left, cut, score in (("op2_quality", 3, 1, 0.5, lambda t: model.score(quality.np.array([quality.features(t)]))[0]), ("op9_toxicity", 4, 2, 0.3, lambda t: net.score([t])[0])):
        got = {r.doc_id: r for r in entry.queries()[name](spark, SF).collect()}
        assert set(got) == set(texts)
        for i, r in got.items():
            assert abs(r.score - score(texts[i])) < 1e-6 and r.predicted == int(r.score >= cut)
            assert r.held_out == (zlib.crc32(str(i).encode()) % mod == left)
