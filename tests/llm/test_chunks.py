"""Chunk reuse against whole-text calls of the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factloom.llm import chunk_reuse
from factloom.llm.encoding import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", " quick", "'", "'s", "'re", "'ll", " don't", "  ", "\n", "\n\n", "\t", " \n ", "12", "3.5", "é", "ß ", "字", "字字。", " ", " ", "́", "<|endoftext|>", "<|", "|>", "endoftext", "!!", " !?", "🙂", "\r\n", "x'", "VE", "_", "a1b2", "\x1c", "\x85", "Ω", " Ωμέγα", "https://a.b/c?d=e"]


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def test_joins_at_any_place_are_repaired():
    rng, enc, table = random.Random(5), encoder(PATH), chunk_reuse.bytes_of_ids(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    for _ in range(150):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(4)]
        pieces = []
        for text in texts:
            at = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))})
            pieces.append([text[a:b] for a, b in zip(at, at[1:])])
        ids, ends = enc.encode(pa.array([p for doc in pieces for p in doc], pa.large_string()))
        doc_ends = ends[np.cumsum([len(doc) for doc in pieces])]
        got, bounds = chunk_reuse.repaired(ids, ends[1:], doc_ends, table, enc.encode)
        for k, text in enumerate(texts):
            assert got[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_sure_cut_begins_a_pre_token():
    rng = random.Random(6)
    tokenizer = Tokenizer.from_file(PATH)
    for _ in range(200):
        text = "".join(rng.choices(PARTS, k=40))
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        for cut in chunk_reuse.sure_cuts(data).tolist():
            a, b = data[:cut].tobytes().decode(), data[cut:].tobytes().decode()
            both = [tokenizer.encode(x, add_special_tokens=False).ids for x in (a, b)]
            assert both[0] + both[1] == tokenizer.encode(text, add_special_tokens=False).ids, (a[-10:], b[:10])


def test_cuts_depend_on_the_text_before_them_only():
    rng = random.Random(7)
    body = "".join(rng.choices(PARTS, k=3000))
    both = pa.array([body, "another begin " + body, ""], pa.large_string())
    view, begins, cuts, hashes, first = chunk_reuse.chunked(both)
    one, two = set(hashes[first[0] : first[1]].tolist()), set(hashes[first[1] : first[2]].tolist())
    assert first[3] == first[2] and len(one) > 20 and len(one & two) >= len(one) - 2
    assert b"".join(bytes(view[a:b]) for a, b in zip(begins, cuts, strict=True)).decode() == body + "another begin " + body


def test_equal_texts_have_equal_chunks_behind_any_other_text():
    rng = random.Random(9)
    for k in range(300):
        body = "".join(rng.choices(PARTS, k=120))
        before = "".join(rng.choices(PARTS, k=rng.randint(1, 60)))
        _, begins, cuts, hashes, first = chunk_reuse.chunked(pa.array([body, before, body], pa.large_string()))
        assert hashes[: first[1]].tolist() == hashes[first[2] : first[3]].tolist(), k


def test_equal_texts_in_several_tasks_are_pieced_together_once(spark):
    rng = random.Random(10)
    bodies = ["".join(rng.choices(PARTS, k=150)) for _ in range(60)]
    rows = [text for copy in range(6) for body in bodies for text in ("".join(rng.choices(PARTS, k=rng.randint(1, 60))), body)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(rows)), 24), "doc_id long, text string")
    got = [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in chunk_reuse.encoded_documents(docs, PATH).orderBy("doc_id").collect()]
    assert got == plain(rows)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(8)
    passage = "".join(rng.choices(PARTS, k=400))
    texts = [passage + str(k) + "".join(rng.choices(PARTS, k=30)) for k in range(20)] + ["".join(rng.choices(PARTS, k=200)) + passage for _ in range(20)]
    return [*texts, texts[0], texts[0], "", None, " ", "字" * 5000, passage * 30, "x" * 100_000]


def test_texts_equal_the_librarys(spark, mixed):
    rows = [(k if k % 7 else None, text, "clash") for k, text in enumerate(mixed)] + [(1, mixed[1], "clash"), (1, mixed[2], "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["doc_id"] or 0) for r in chunk_reuse.encoded_documents(docs, PATH).collect())
    want = sorted((*p, r[0] or 0) for p, r in zip(plain([r[1] for r in rows]), rows))
    assert got == want


def test_a_filter_that_is_full_changes_nothing(spark, mixed, monkeypatch):
    monkeypatch.setattr(chunk_reuse, "repeated_filter", lambda listed: chunk_reuse.Filter(15, {0: b"\xff" * 4096}))
    docs = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    got = [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in chunk_reuse.encoded_documents(docs, PATH).orderBy("doc_id").collect()]
    assert got == plain(mixed)


def test_an_empty_table(spark):
    assert chunk_reuse.encoded_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
