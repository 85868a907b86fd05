"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so have a few pairs of features.
Boosting goes round the features in a cycle, each time adding a shallow tree (four leaves of
neighbouring bins) of one feature to its table; then pairs, picked by how much four quadrants
explain of what is left, get their turns. A score is the sum of looked-up values: vectorised
additions over bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.labelled import fold, labelled_sample, one_each

FEATURES = ["log_chars", "word_length", "upper", "digit", "exclaim", "sign", "stop", "space", "other", "distinct_words", "top_word", "words_a_line", "repeated_lines", "line_ends", "sign_words", "top_byte"]


def _class_table() -> np.ndarray:
    """Rows: upper, lower, digit, exclaim or question mark, full stop or comma, white space, other signs; columns: Latin-1 bytes."""
    table = np.zeros((7, 256))
    for b in range(256):
        c = chr(b)
        kind = 0 if c.isupper() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "!?" else 4 if c in ".,;:'\"-" else 5 if c.isspace() else 6
        table[kind, b] = 1
    return table


CLASSES = _class_table()
SIGN_BYTES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
SIGNS = bytes.maketrans(SIGN_BYTES, b"#" * len(SIGN_BYTES))


def features(text: str | None) -> list[float]:
    """The features of a whole text; null is empty."""
    text = text or ""
    count = np.bincount(np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8), minlength=256)
    n = max(1, len(text))
    upper, lower, digit, exclaim, stop, space, sign = (CLASSES @ count).tolist()
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n_words = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    shape = raw.translate(SIGNS)
    return [
        float(np.log1p(len(text))),
        (len(text) - space) / n_words,
        upper / max(1.0, upper + lower),
        digit / n,
        exclaim / n,
        sign / n,
        stop / n,
        space / n,
        float((np.frombuffer(raw, dtype=np.uint8) >= 128).mean()) if raw else 0.0,
        len(seen) / n_words,
        max(seen.values(), default=0) / n_words,
        float(np.log1p(len(words) / n_lines)),
        1 - len(set(lines)) / n_lines if lines else 0.0,
        ends / n_lines,
        (shape.count(b"## ") + shape.count(b"# #") + shape.count(b"##\n")) / n_words,
        float(count.max()) / n,
    ]


@dataclass
class Additive:
    """Cuts of each feature, a table of each feature and of each pair, and the base value."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[tuple[np.ndarray, np.ndarray]]
    pair_tables: list[np.ndarray]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (cuts, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(cuts, x[:, f], side="right")]
        for (a, b), (ca, cb), t in zip(self.pairs, self.pair_cuts, self.pair_tables, strict=True):
            z += t[np.searchsorted(ca, x[:, a], side="right"), np.searchsorted(cb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between neighbouring quantiles of a feature."""
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))
    return (q[1:] + q[:-1]) / 2 if len(q) > 1 else np.zeros(0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of each bin: bins are cut where the gain is largest until there are ``leaves`` runs."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges = [0, len(g)]
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                won = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (won[k], int(m[k]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, bins: int = 32, pair_bins: int = 6, n_pairs: int = 6, rounds: int = 150, rate: float = 0.1, ridge: float = 2.0) -> Additive:
    """Train on a sample; one class alone (or nothing) gives a constant score."""
    n, d = x.shape if x.ndim == 2 else (0, len(FEATURES))
    weight = np.ones(n) if weight is None else weight
    share = (float((weight * y).sum()) + 1) / (float(weight.sum()) + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [cuts_of(x[:, f], bins) if n else np.zeros(0) for f in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = Additive(cuts, tables, [], [], [], base)
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    z = np.full(n, base)
    for _ in range(rounds):
        for f in range(d):
            if len(tables[f]) < 2:
                continue
            p = 1 / (1 + np.exp(-z))
            size = len(tables[f])
            step = rate * shallow_tree(np.bincount(at[f], weight * (y - p), size), np.bincount(at[f], weight * p * (1 - p), size), 4, ridge)
            tables[f] += step
            z += step[at[f]]
    coarse = [cuts_of(x[:, f], pair_bins) for f in range(d)]
    cell = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
    p = 1 / (1 + np.exp(-z))
    won = []
    for a, b in combinations(range(d), 2):
        sa, sb = len(coarse[a]) + 1, len(coarse[b]) + 1
        if sa < 2 or sb < 2:
            continue
        g = np.bincount(cell[a] * sb + cell[b], weight * (y - p), sa * sb).reshape(sa, sb).cumsum(0).cumsum(1)
        h = np.bincount(cell[a] * sb + cell[b], weight * p * (1 - p), sa * sb).reshape(sa, sb).cumsum(0).cumsum(1)
        quad = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
        won.append((float(sum(u**2 / (v + ridge) for u, v in zip(quad(g), quad(h), strict=True)).max()), a, b))
    for _, a, b in sorted(won, reverse=True)[:n_pairs]:
        model.pairs.append((a, b))
        model.pair_cuts.append((coarse[a], coarse[b]))
        model.pair_tables.append(np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)))
    for _ in range(rounds // 3):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            spot, size = cell[a] * t.shape[1] + cell[b], t.size
            g = np.bincount(spot, weight * (y - p), size).reshape(t.shape)
            h = np.bincount(spot, weight * p * (1 - p), size).reshape(t.shape)
            halves = shallow_tree(g.sum(1), h.sum(1), 2, ridge)
            low = halves == halves[0]
            step = np.zeros(t.shape)
            for rows in (low, ~low):
                if rows.any():
                    step[rows] = shallow_tree(g[rows].sum(0), h[rows].sum(0), 2, ridge)
            t += rate * step
            z += rate * step[cell[a], cell[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, *, most: int = 20_000, mod: int = 3, held_out: int = 1, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on the labelled documents of at most ``most`` ids outside the held-out fold, one for each; only their features reach the driver."""
    sample, weights = labelled_sample(docs, labels, label, mod, held_out, most, {"text": F.col(text_col)}, id_col=id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y").cast(pa.float64()), pa.array(found, pa.list_(pa.float64()))], names=["_id", "y", "x"])

    found = one_each(sample.select("_id", "y", "text").mapInArrow(run, "_id bigint, y double, x array<double>"))
    rows = sorted((tuple(r["x"]), r["y"]) for r in found.collect())
    y = np.array([r[1] for r in rows])
    return fit(np.array([r[0] for r in rows]), y, weight=np.where(y > 0, weights[1], weights[0]) if len(y) else None)


def scored(docs: DataFrame, model: Additive, columns: dict[str, Column], text_col: str) -> DataFrame:
    """_row (a struct of the given columns) and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(c.alias(name) for name, c in columns.items())).alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(found))], names=["_row", "score"])

    return rows.mapInArrow(run, rows.select("_row").schema.add("score", "double"))


def quality_scores(docs: DataFrame, model: Additive, *, mod: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts are scored as empty ones, null ids are not held out, repeated rows and ties score
    alike; very long texts are scored whole; an empty table gives an empty result. Nothing but the text is an
    input of the score; other columns are ignored, whatever their names.
    """
    out = scored(docs, model, {"id": F.col(id_col).cast("long")}, text_col)
    return out.select(F.col("_row.id").alias("doc_id"), (fold(F.col("_row.id"), mod) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Additive, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score ``least`` or more."""
    names = {f"c{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)}
    return scored(docs, model, names, text_col).where(F.col("score") >= least).select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
