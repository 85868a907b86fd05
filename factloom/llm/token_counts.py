"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer_digest, content_digest, n_tokens). Normalised content
(null becomes the empty text, nothing else: a byte-level tokenizer sees every other change) and
the tokenizer's version are digested, the documents' digests are joined to the cache, one text of
each missing digest is encoded, and the new counts are appended.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encoding import encoder, slices, tokenizer_digest
from factloom.llm.shared import staged

#: So many digests a task remembers.
MET = 100_000
CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens bigint"


def open_cache(spark, cache_path: str) -> DataFrame:
    """The cache table; an empty one is written where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("ignore").parquet(cache_path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_with(tokenizer_path: str):
    """A mapper from (content_digest, text) to (content_digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                _, ends = enc.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(np.diff(ends))], names=["content_digest", "n_tokens"])

    return run


def may_be_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (content_digest, doc_id, text) without those of a text that the task has met lately with a smaller or the same id: copies leave before they are sent."""
    least: OrderedDict[bytes, float] = OrderedDict()
    for batch in batches:
        keep = []
        for digest, own in zip(batch.column("content_digest").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            own = float("inf") if own is None else own
            keep.append(digest not in least or own < least[digest])
            if keep[-1]:
                least[digest] = own
            least.move_to_end(digest)
            if len(least) > MET:
                least.popitem(last=False)
        yield batch.filter(pa.array(keep, pa.bool_()))


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``; fills the cache on the way.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows and null ids stay as they are,
    each with its own count; of equal texts any one is encoded. Very long texts are counted whole. An empty table gives an empty result. Other columns of ``docs`` are
    ignored, whatever their names. The text moves once, by (digest, id), so that a group of equal
    texts spreads over tasks and its copies mostly never leave their task; of each missing digest one row with its smallest id is encoded.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    light = staged(rows.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    cache = open_cache(spark, cache_path)
    known = cache.where(F.col("tokenizer_digest") == version).select("content_digest")
    misses = light.groupBy("content_digest").agg(F.min("doc_id").alias("rep")).join(known.distinct(), "content_digest", "left_anti")
    some = rows.mapInArrow(may_be_first, rows.schema)
    # Plain key columns for an id that may be null: both the join and the removal of copies deal rows by them, so texts move once.
    keys = lambda df, own: df.withColumns({"_id": F.coalesce(own, F.lit(0)), "_none": F.col(own).isNull()})
    picked = keys(some, "doc_id").join(keys(misses, "rep").hint("shuffle_hash"), ["content_digest", "_id", "_none"], "left_semi")
    counted = picked.dropDuplicates(["content_digest", "_id", "_none"]).select("content_digest", "text").mapInArrow(count_with(tokenizer_path), "content_digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = staged(counts, "token-counts")  # a plain table, so that a group of equal texts is a skewed join that is split
    return light.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
