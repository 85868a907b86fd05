"""Toxicity by a convolutional text classifier in numpy.

Words (letters and digits, lower case) and their first three, four and five bytes are hashed into
one table of embeddings; a word is the sum of its rows. Filters over one, two and three words are
max-pooled over the whole text and weighed by a logistic layer. All parameters are trained by
Adam on a bounded labelled sample. Thresholds are calibrated by language on a part of the sample
that is not trained on; the language is no input of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.llm.labelled import fold, labelled_sample, one_each

SIGNS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
HASHES = 4
CHUNK = 50_000
ROWS = 1 << 16


def word_list(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(SIGNS).split()


def buckets(word: bytes, rows: int) -> list[int]:
    """Row numbers of a word and of its beginnings; row 0 stays empty."""
    return [1 + xxh64_intdigest(word) % (rows - 1), *(1 + xxh64_intdigest(word[:n], seed=n) % (rows - 1) if len(word) >= n else 0 for n in (3, 4, 5))]


def word_rows(text: str | None, rows: int) -> np.ndarray:
    """The row numbers of each word of a text, ``HASHES`` a word."""
    return np.array([buckets(w, rows) for w in word_list(text)], dtype=np.uint32).reshape(-1, HASHES)


class Numbered(dict):
    """Numbers words as they come; ``fresh`` collects the new ones."""

    fresh: list[bytes]

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k


@dataclass
class ConvNet:
    table: np.ndarray  # rows x dim
    filters: list[np.ndarray]  # for each width: width x dim x number
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def vectors(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after the other, each after ``PAD`` empty ones, and the end of each text."""
        known = self.__dict__.setdefault("_known", Numbered())
        if len(known) > 150_000:
            known.clear()
        if not known:
            known[b""] = 0
            self._vocab = np.zeros((1024, self.table.shape[1]), np.float32)
        flat: list[int] = []
        ends = []
        known.fresh = fresh = []
        for own in words:
            flat += [0] * PAD
            flat.extend(map(known.__getitem__, own or [b""]))
            ends.append(len(flat))
        if fresh:
            if len(known) > len(self._vocab):
                bigger = np.zeros((max(2 * len(self._vocab), len(known)), self._vocab.shape[1]), np.float32)
                bigger[: len(self._vocab)] = self._vocab
                self._vocab = bigger
            rows = np.array([buckets(w, len(self.table)) for w in fresh])
            self._vocab[len(known) - len(fresh) : len(known)] = self.table[rows].sum(1)
        return np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64)

    def forget(self) -> None:
        """Drop the vectors of words met so far."""
        self.__dict__.pop("_known", None)
        self.__dict__.pop("_vocab", None)

    def pooled(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest response of each filter within each run of rows of ``x``."""
        cuts = np.stack([starts, ends], 1).reshape(-1)
        cuts = cuts[:-1] if cuts[-1] == len(x) else cuts
        return np.concatenate([np.maximum.reduceat(respond(x, f), cuts, axis=0)[::2] for f in self.filters], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        todo: list[tuple[int, list[bytes], int]] = []
        size = 0
        best: dict[int, np.ndarray] = {}

        def flush() -> None:
            nonlocal todo, size
            if todo:
                flat, ends = self.vectors([w for _, w, _ in todo])
                starts = np.concatenate([[0], ends[:-1]]) + PAD + np.array([skip for _, _, skip in todo])
                top = self.pooled(self._vocab[flat], starts, ends)
                for (i, _, _), row in zip(todo, top, strict=True):
                    best[i] = np.maximum(best[i], row) if i in best else row
            todo, size = [], 0

        for i, t in enumerate(texts):
            words = word_list(t)
            for a in range(0, max(1, len(words)), CHUNK):  # a long text goes in parts; the words before one are only looked back at
                skip = min(a, PAD)
                part = words[a - skip : a + CHUNK]
                todo.append((i, part, skip))
                size += len(part)
                if size > 2 * CHUNK:
                    flush()
        flush()
        for i in range(len(texts)):
            out[i] = self.value(best[i])
        return out

    def value(self, top: np.ndarray) -> float:
        z = float(np.maximum(top + self.bias, 0) @ self.out) + self.base
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

    def score_rows(self, docs: list[np.ndarray]) -> np.ndarray:
        """Scores of documents given by their words' row numbers."""
        embedded = (self.table[padded(d)].sum(1) for d in docs)
        return np.array([self.value(np.concatenate([respond(x, f)[PAD:].max(0) for f in self.filters])) for x in embedded])


def respond(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Responses of filters that end at each row."""
    got = x @ f[-1]
    for k in range(1, len(f)):
        got[k:] += x[:-k] @ f[-1 - k]
    return got


def padded(words: np.ndarray) -> np.ndarray:
    """A document's row numbers after ``PAD`` empty words; without words, one empty word."""
    return np.concatenate([np.zeros((PAD, HASHES), np.int64), words if len(words) else np.zeros((1, HASHES), np.int64)])


def fit(texts: list, y: np.ndarray, weight: np.ndarray | None = None, *, rows: int = ROWS, dim: int = 16, number: int = 8, epochs: int = 4, rate: float = 0.01, batch: int = 32, seed: int = 7, decay: float = 0.3) -> ConvNet:
    """Train by Adam on texts or on their words' row numbers; the gradient runs through each filter's largest response. One class alone gives a constant.

    ``decay`` draws the embeddings of words met towards zero, so that a few odd labels don't make
    rare words toxic.
    """
    rng = np.random.default_rng(seed)
    net = ConvNet(
        np.concatenate([np.zeros((1, dim)), rng.normal(0, 0.1, (rows - 1, dim))]).astype(np.float32),
        [rng.normal(0, (1 / (w * dim)) ** 0.5, (w, dim, number)).astype(np.float32) for w in WIDTHS],
        np.zeros(number * len(WIDTHS), np.float32),
        rng.normal(0, 0.3, number * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    weight = np.ones(len(y)) if weight is None else weight
    share = (float((weight * y).sum()) + 1) / (float(weight.sum()) + 2)
    net.base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    docs = [padded(t if isinstance(t, np.ndarray) else word_rows(t, rows)).astype(np.int64) for t in texts]
    params = [net.table, *net.filters, net.bias, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, base_m, base_v = 0, 0.0, 0.0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            grads = [np.zeros_like(p) for p in params]
            touched = []
            base_g = 0.0
            for i in own:
                x = net.table[docs[i]].sum(1)
                tops, at = [], []
                for f in net.filters:
                    r = respond(x, f)[PAD:]
                    k = r.argmax(0)
                    at.append(k + PAD)
                    tops.append(r[k, np.arange(r.shape[1])])
                raw = np.concatenate(tops) + net.bias
                hidden = np.maximum(raw, 0)
                z = float(hidden @ net.out) + net.base
                d = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(own)
                grads[-1] += d * hidden
                base_g += d
                dh = d * net.out * (raw > 0)
                grads[-2] += dh
                for j, (f, k) in enumerate(zip(net.filters, at, strict=True)):
                    part = dh[j * number : (j + 1) * number]
                    for t in range(len(f)):
                        spot = k - t
                        grads[1 + j][len(f) - 1 - t] += (x[spot] * part[:, None]).T
                        back = (f[len(f) - 1 - t] * part).T
                        h = docs[i][spot]
                        for c in range(HASHES):
                            np.add.at(grads[0], h[:, c], back)
                        touched.append(h.reshape(-1))
            grads[0][0] = 0
            step += 1
            fix = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            rows_now = np.unique(np.concatenate(touched))
            for n, (p, g) in enumerate(zip(params, grads, strict=True)):
                if n == 0:  # only the rows that this batch met
                    g = g[rows_now]
                    m[0][rows_now] = 0.9 * m[0][rows_now] + 0.1 * g
                    v[0][rows_now] = 0.999 * v[0][rows_now] + 0.001 * g * g
                    p[rows_now] -= rate * (fix * m[0][rows_now] / (np.sqrt(v[0][rows_now]) + 1e-6) + decay * p[rows_now])
                else:
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    p -= rate * fix * m[n] / (np.sqrt(v[n]) + 1e-6)
            base_m, base_v = 0.9 * base_m + 0.1 * base_g, 0.999 * base_v + 0.001 * base_g**2
            net.base -= rate * fix * base_m / (base_v**0.5 + 1e-6)
            net.table[0] = 0
    return net


def best_threshold(scores: np.ndarray, y: np.ndarray, default: float) -> float:
    """The cut with the best F1, in the middle of its gap; ``default`` without both classes."""
    if not len(y) or y.min() == y.max():
        return default
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, *, most: int = 4_000, longest: int = 1 << 15, mod: int = 4, held_out: int = 2, label: str = "toxic", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ConvNet:
    """Fit on labelled documents of at most ``most`` ids and ``longest`` bytes outside the held-out fold, a fifth of them kept to calibrate.

    Longer documents are no examples and take no places; they are scored whole all the same. What reaches the driver is the row numbers of their words, of one document for each id: at most
    ``most`` times ``longest`` times four bytes, whatever the size of the corpus.
    """
    short = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= longest)
    sample, weights = labelled_sample(short, labels, label, mod, held_out, most, {"text": F.col(text_col), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(""))}, id_col=id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_rows(t.as_py(), ROWS).astype("<u2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), batch.column("lang"), pa.array(found, pa.binary())], names=["_id", "y", "lang", "words"])

    found = one_each(sample.select("_id", "y", "lang", "text").mapInArrow(run, "_id bigint, y int, lang string, words binary"))
    rows = sorted(((bytes(r["words"]), r["lang"], r["y"]) for r in found.collect()), key=lambda r: (xxh64_intdigest(r[0]), r))
    words = [np.frombuffer(r[0], "<u2").reshape(-1, HASHES) for r in rows]
    y = np.array([r[2] for r in rows], dtype=float)
    spare = len(rows) // 5 if len(rows) >= 500 else 0
    net = fit(words[spare:], y[spare:], np.where(y[spare:] > 0, weights[1], weights[0]))
    scores = net.score_rows(words[:spare])
    for lang in sorted({r[1] for r in rows[:spare]}):
        own = np.array([r[1] == lang for r in rows[:spare]])
        net.thresholds[lang] = best_threshold(scores[own], y[:spare][own], threshold)
    return net


def scored(docs: DataFrame, net: ConvNet, columns: dict[str, Column], text_col: str) -> DataFrame:
    """_row (a struct of the given columns) and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.struct(*(c.alias(name) for name, c in columns.items())).alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(batch.column(1).slice(a, 500).to_pylist()) for a in range(0, batch.num_rows, 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["_row", "score"])
        shared.value.forget()  # workers are used again, by other stages too

    return rows.mapInArrow(run, rows.select("_row").schema.add("score", "double"))


def cut_of(lang: Column, net: ConvNet, threshold: float) -> Column:
    """The calibrated threshold of a language; ``threshold`` for languages that the calibration hasn't met."""
    cut = F.lit(threshold)
    for name, own in net.thresholds.items():  # a handful
        cut = F.when(F.coalesce(lang.cast("string"), F.lit("")) == name, F.lit(own)).otherwise(cut)
    return cut


def toxicity_scores(docs: DataFrame, net: ConvNet, *, mod: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold of every row.

    ``predicted`` is score >= ``threshold``; ``lang_threshold`` is the calibrated cut of the row's
    language (null is a language of its own). Null texts are scored as empty ones, null ids are not held out, repeated rows and ties score
    alike; very long texts are scored whole, in parts; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    out = scored(docs, net, {"id": F.col(id_col).cast("long"), "lang": F.col(lang_col)}, text_col)
    return out.select(F.col("_row.id").alias("doc_id"), (fold(F.col("_row.id"), mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), cut_of(F.col("_row.lang"), net, threshold).alias("lang_threshold"))


def passed(docs: DataFrame, net: ConvNet, *, threshold: float = 0.3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score below their language's calibrated threshold."""
    names = {"lang": F.col(f"`{lang_col}`")} | {f"c{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)}
    out = scored(docs, net, names, text_col)
    return out.where(F.col("score") < cut_of(F.col("_row.lang"), net, threshold)).select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
