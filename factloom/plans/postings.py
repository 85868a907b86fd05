"""Search over an inverted table: postings of tokens, written once in buckets, instead of all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import tokens
from factloom.operators.search import WEIGHTS, keyword_hits
from factloom.scratch import shared_dir

BUCKETS = 64


def bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(findings: DataFrame) -> DataFrame:
    """token, id: the tokens of a finding's fields, each once for a finding; made in its row, so nothing is sent for it."""
    fields = [f for f in WEIGHTS if f in findings.columns]
    every = F.flatten(F.array(*(tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields)))
    return findings.select("id", F.explode(F.array_distinct(every)).alias("token")).select("token", "id")


def write_postings(findings: DataFrame, path: str) -> None:
    """The postings, one folder for each bucket of tokens, sorted by token in it: a search opens its tokens' folders and row groups only."""
    rows = postings(findings).withColumn("bucket", bucket(F.col("token")))
    # A frequent token's rows are dealt to several files by id.
    rows = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "token", "id")
    rows.write.partitionBy("bucket").parquet(path)


def postings_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/postings-{name}"


#: Up to so many candidates are sent to all tasks; more of them are a good part of all texts, which are then read and filtered where they lie.
MOST_CANDIDATES = 200_000


def posted_hits(findings: DataFrame, posted: DataFrame, query: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """The rows and scores of ``keyword_hits``: findings without all of the query's tokens are left out by their postings, and only the others' texts are read and scored.

    ``posted`` is the written table. Tokens meet from the rarest on, so a join's left side is never larger
    than the rarest token's postings. A query without tokens is searched in the texts, as is one whose rarest token has over
    ``most`` findings; texts are never sent.
    """
    spark = findings.sparkSession
    words = spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query.strip())))).alias("token")).select("token", bucket(F.col("token")).alias("bucket")).collect()
    if not words:
        return keyword_hits(findings, query)
    mine = posted.where(F.col("bucket").isin(sorted({w["bucket"] for w in words})) & F.col("token").isin([w["token"] for w in words]))
    counts = {r["token"]: r["n"] for r in mine.groupBy("token").agg(F.count("*").alias("n")).collect()}  # the query's tokens
    if len(counts) < len(words):
        return keyword_hits(findings.limit(0), query)
    order = sorted(counts, key=lambda t: (counts[t], t))
    if counts[order[0]] > most:
        return keyword_hits(findings, query)
    of = lambda token: mine.where(F.col("token") == token).select("id")
    ids = of(order[0])
    for token in order[1:]:
        ids = ids.join(of(token), "id", "left_semi")
    return keyword_hits(findings.join(F.broadcast(ids), "id", "left_semi"), query)  # at most ``most`` rows
