"""Importance resampling towards a target distribution of hashed word n-grams.

Words and pairs of words are hashed by CRC-32 into buckets. A bucket's gain is the logarithm of
how much more often the target has it than the corpus; a document's weight is its features' mean
gain. The documents with the largest sums of weight and Gumbel noise (from a hash of the id) are
drawn: a sample without replacement, in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.crc_spans import crc32_spans
from factloom.llm.encoding import slices
from factloom.llm.shared import staged

#: Word bytes stand for themselves, A to Z for their lower case, all others for a blank.
FOLD = np.array([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], dtype=np.uint8)


def hashed_features(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32 of each run of 1 to ``n`` words, the row it is of), by run length; the words of a run are joined by one blank.

    Runs of one length and of one place modulo the length don't overlap, so each such group is one gather.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    spaced = pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))  # so that no word reaches into the next text
    ends = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    raw = FOLD[np.frombuffer(spaced.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]]
    word = raw != 0x20
    first = word.copy()
    first[1:] &= ~word[:-1]
    keep = word.copy()
    keep[1:] |= word[:-1]  # and one blank after each word
    buffer = raw[keep]
    at = np.flatnonzero(first)
    row = np.searchsorted(ends - ends[0], at, side="right") - 1
    starts = (np.cumsum(keep) - 1)[at]
    lengths = np.diff([*starts, len(buffer)]) - 1 if len(starts) else starts
    crcs, rows = [], []
    for size in range(1, n + 1):
        k = len(starts) - size + 1
        if k < 1:
            break
        same = row[:k] == row[size - 1 :]
        for turn in range(size):
            pick = np.flatnonzero(same[turn::size]) * size + turn
            crcs.append(crc32_spans(buffer, starts[pick], starts[pick + size - 1] + lengths[pick + size - 1] - starts[pick]))
            rows.append(row[pick])
    return (np.concatenate(crcs), np.concatenate(rows)) if crcs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def histogram(n: int, buckets: int):
    """A mapper from texts to (bucket, n) of what a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(hashed_features(part.column("text"), n)[0] % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, text: Column, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket holds; ``buckets`` rows at most reach the driver."""
    parts = rows.select(text.alias("text")).mapInArrow(histogram(n, buckets), "bucket int, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighted(gains: np.ndarray, n: int):
    """A mapper from (doc_id, text) to doc_id, n_features and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                crcs, rows = hashed_features(part.column("text"), n)
                gain = np.zeros(part.num_rows, dtype=np.int64)
                np.add.at(gain, rows, gains[crcs % len(gains)])
                count = np.bincount(rows, minlength=part.num_rows)
                weight = np.where(count > 0, gain // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, *, n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: str = "7:", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    Null texts have no words. A null id is the empty text in the hash and comes after the others in
    ties. Rows that repeat an id share its noise and are drawn each for itself; of equal rows at the
    edge any are drawn. Without words the weight is 0. Very long texts are hashed whole. With an empty
    target all gains follow from the corpus alone, and an empty table gives an empty result. Other
    columns are ignored. Texts are read twice (counts, then weights) and never move; ranks are made in
    ranges of scores, so no task holds all rows, and only bucket counts reach the driver.
    """
    text = F.col(text_col)
    gains = bucket_gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, F.col("text"), n, buckets))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(weighted(gains, n), "doc_id bigint, n_features bigint, weight bigint")
    scored = staged(scored.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "_row": F.monotonically_increasing_id()}), "scores")
    # of runs of 1 to n words, w words (n or more of them) have n*w - n(n-1)/2
    long_enough = F.col("n_features") >= (n * least_words - n * (n - 1) // 2 if least_words >= n else least_words)
    some = scored.where(long_enough)
    drawn = some.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ranges = staged(some.select("score", "doc_id", "_row").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "score-ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranks = ranges.join(F.broadcast(starts.where(F.col("_before") < drawn)), "_range")
    ranks = ranks.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).where(F.col("rank") <= drawn)
    return scored.join(ranks.select("_row", F.col("rank").cast("long").alias("rank")), "_row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql(buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: str = "7:") -> str:
    """The same by SQL for runs of one and two words; CRC-32 byte by byte over distinct features."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = "case when {0} % 2 = 1 then xor({0} // 2, 3988292384) else {0} // 2 end"
    return f"""with recursive bits(b, v, k) as (select range::bigint, range::bigint, 0 from range(256) union all select b, {step.format('v')}, k + 1 from bits where k < 8),
tab as materialized (select list(v order by b) as t from bits where k = 8),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') as w from documents),
g as (select regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') as w from benchmark),
f as materialized (select rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from d),
q as materialized (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from g),
kinds as materialized (select f from f union select f from q),
bytes as (select f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint) as bs from kinds),
hashed as materialized (select f, xor(list_reduce(list_prepend(4294967295::bigint, bs), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % {buckets} as bucket from bytes, tab),
fb as materialized (select rid, bucket from f join hashed using (f)),
s as (select bucket, count(*) as s from fb group by bucket), t as (select bucket, count(*) as t from q join hashed using (f) group by bucket),
gains as materialized (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from fb) + {buckets}) / ((coalesce(s, 0) + 1)::double * ((select count(*) from q) + {buckets}))))::bigint as gain from s full join t using (bucket)),
w as (select rid, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from fb join gains using (bucket) group by rid),
sc as (select rid, doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0) as weight, len(d.w) as words,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join w using (rid)),
r as (select rid, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from sc where words >= {least_words})
select doc_id, n_features, weight, score, case when rank <= {percent} * n // 100 then rank end::bigint as rank from sc left join r using (rid)"""
