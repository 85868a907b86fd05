import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import packing, token_binary, token_counts
from factloom.llm.encoding import encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  a b", "a  b", " x", "x ", "a\n b", "a <|endoftext|> b<|endoftext|>", "I'm he's", "é́a b", "a\x1cb c", "ß Σ ΑΣ İ", "12 345 ,,!!", "<|startoftext|>x", "漢字 かな 🙂", "It!! x***y", "  a  b"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_librarys_ids(path):
    plain = Tokenizer.from_file(path)
    for texts in (ODD, ODD[:1], []):
        ids, ends = encoder(path).encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBz éŉſßΣ.'!|<>_#0 \n\t ́漢"), max_size=30), min_size=1, max_size=4))
def test_encoder_on_drawn_texts(texts):
    for path in (BYTE, WORD):
        plain = Tokenizer.from_file(path)
        ids, ends = encoder(path).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def documents(spark, texts):
    rows = [(k if k != 5 else None, t, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, content_digest string")


def test_token_counts_and_cache(spark, tmp_path):
    docs = documents(spark, [*ODD, "a b", "a b", "word " * 3000])
    plain, cache = Tokenizer.from_file(BYTE), str(tmp_path / "cache")
    for _ in range(2):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, cache, BYTE).collect())
        want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), n := len(plain.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect())
        assert got == want
    kept = spark.read.parquet(cache)
    assert kept.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.token_counts(docs.limit(0), str(tmp_path / "none"), BYTE).count() == 0


def test_one_row_a_digest_is_encoded(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    inner = token_counts.count_with

    def counting(path):
        def run(batches):
            def counted():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from inner(path)(counted())

        return run

    monkeypatch.setattr(token_counts, "count_with", counting)
    rows = [(1, "same text")] * 30 + [(None, "same text")] * 20 + [(None, "only without an id")] * 21
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), str(tmp_path / "c"), BYTE)
    assert got.count() == 71 and seen.value == 2
    token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "c"), BYTE).collect()
    assert seen.value == 2  # all are hits now


def test_rans_round_trip_and_parts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 1000, 300_000):
        ids = np.minimum(rng.geometric(0.01, n), 40_000)
        coder = token_binary.Coder(token_binary.quantised({int(t): int(c) for t, c in zip(*np.unique(ids, return_counts=True), strict=True)}))
        coded = coder.encode(ids)
        assert (coder.decode(coded, n) == ids).all()
        parts = [coder.decode(coded, n, k) for k in range(len(coded["marks"]) // 2 + 1)]
        assert (np.concatenate(parts) == ids).all()
    assert len(coded["marks"]) == 0 or len(parts) > 1
    assert len(coded["words"]) < 2 * n


def test_token_files(spark, tmp_path):
    docs = documents(spark, [*ODD, "many words " * 2000])
    path = str(tmp_path / "t")
    token_binary.write_tokens(docs, path, WORD, block_tokens=500)
    plain, start = Tokenizer.from_file(WORD), 0
    got = {r.doc_id: r for r in token_binary.read_tokens(spark, path, with_ids=True).collect()}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids) == (start, len(ids), ids) and g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_binary.write_tokens(docs.limit(0), str(tmp_path / "none"), WORD)
    assert token_binary.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_damaged_blocks_are_told(spark, tmp_path):
    path = str(tmp_path / "t")
    token_binary.write_tokens(documents(spark, ["some words here"]), path, WORD)
    spark.read.parquet(f"{path}/blocks").withColumn("words", F.lit(b"1234")).write.parquet(f"{path}/bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}/bad/table")
    with pytest.raises(Exception, match="damaged"):
        token_binary.read_tokens(spark, f"{path}/bad").collect()


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 40), max_size=60))
def test_plan_places_everything(histogram):
    plan = packing.plan_packing(dict(histogram), groups=16)
    seen, filled = {}, {}
    for length, rank, count, first, offset in plan.runs:
        assert rank == seen.get(length, 0)
        seen[length] = rank + count
        for k in range(count):
            filled.setdefault(first + k, []).append((offset, length))
    assert seen == histogram
    for spots in filled.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n * c for n, c in histogram.items())
    assert len(filled) == plan.sequences >= -(-total // 1024)
    assert plan.sequences <= 1.34 * total / 1024 + 18


def test_packing(spark):
    docs = documents(spark, [*ODD, "x " * 5000, "x " * 5000])
    plain = Tokenizer.from_file(BYTE)
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack_documents(docs, BYTE).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[d])
        assert all(r.length == 1024 for r in own[1:])
    for spots in by_seq.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 1024
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0
