"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's k-grams of code points are hashed, each window of ``w`` neighbouring hashes picks its
least one (of equal ones the rightmost), and the picks with their places are the fingerprint. Two
texts that share ``k + w - 1`` code points in a row share a pick.

A text is encoded once with four bytes for each code point, so a k-gram is ``4 * k`` bytes at a known
place and is cut and hashed in one step. Minima are built by widening: over 4 places, then 16, then
32, each one pass over an array, whatever w is. A pick is one long: 31 bits of hash above, and below
them the place counted down from 2^31 - 1, so that of equal hashes the rightmost is the least. Texts of
under k code points have one pick, the hash of the whole; the empty text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import staged

TOP = (1 << 31) - 1
BYTES_A_CHAR = 4
K, W = 16, 32
ROWS_A_BUCKET = 1024
MOST_BUCKETS = 10_000
SAMPLE_A_BUCKET = 20


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def widened(array: Column, step: int, times: int, merge) -> Column:
    """Element i merged with those ``step``, ``2 * step``... places on, ``times`` of them in all; places past the end are null."""
    return let(array, lambda a: F.transform(a, lambda x, i: merge(x, *(F.get(a, i + step * j) for j in range(1, times)))))


def factors(n: int) -> list[int]:
    """A power of two as 4s, and a 2 if need be."""
    if n < 2 or n & (n - 1):
        raise ValueError("w is a power of two")
    bits = n.bit_length() - 1
    return [4] * (bits // 2) + [2] * (bits % 2)


def widen_to(array: Column, width: int, merge) -> Column:
    step = 1
    for times in factors(width):
        array, step = widened(array, step, times, merge), step * times
    return array


def pick(hashed: Column, place: Column, offset: Column) -> Column:
    """A hash with its place below, as one long; places count from ``offset``."""
    return hashed.bitwiseAND(F.lit(TOP << 32).cast("long")) + (F.lit(TOP).cast("long") - offset - place)


def grams(text: Column, n: Column, offset: Column, k: int) -> Column:
    """The picks of all k-grams of a text of ``n`` >= ``k`` code points, in order."""
    starts = F.sequence(F.lit(1), F.greatest((n - k) * BYTES_A_CHAR + 1, F.lit(1)), F.lit(BYTES_A_CHAR))
    return let(F.encode(text, "UTF-32"), lambda b: F.transform(starts, lambda at, i: pick(F.xxhash64(F.substring(b, at, F.lit(BYTES_A_CHAR * k))), i, offset)))


def windows(text: Column, n: Column, offset: Column, k: int = K, w: int = W) -> Column:
    """The pick of every window of a text of ``n`` code points, in order; one window if there are fewer places than ``w``."""
    every = F.slice(widen_to(grams(text, n, offset, k), w, F.least), F.lit(1), F.greatest(n - (k + w - 2), F.lit(1)))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(pick(F.xxhash64(text), F.lit(0), offset))).otherwise(every)


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The picks of a text, in order of their windows; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(windows(text, F.length(text), F.lit(0).cast("long"), k, w))


def shown(picks: Column) -> Column:
    """Picks as text: hash and place (counted down from 7fffffff) as one hexadecimal number each."""
    return F.array_join(F.transform(picks, lambda p: F.hex(p)), " ")


def hashes_of(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: F.shiftright(p, 32)))


def first_picks(picks: Column, last: Column) -> Column:
    """Distinct picks in order of their windows, up to ``last``; none if it is null."""
    return F.when(last.isNull(), F.array().cast("array<bigint>")).otherwise(F.slice(picks, F.lit(1), F.array_position(picks, last).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints (distinct hashes each); 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def ordered(number: Column) -> Column:
    """A long as 16 hexadecimal digits in the numbers' order."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def place_key(doc_id: Column, tie: Column, row: Column) -> Column:
    """A string in the order of rows: ids (null first), their texts' hashes, then the rows' own numbers."""
    return F.concat(F.when(doc_id.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), ordered(doc_id))), F.lit("."), ordered(tie), F.lit("."), ordered(row))


def cut_keys(docs: DataFrame, buckets: int, rows: int) -> list[str]:
    """Keys that cut the rows into about equal parts, from a sample of ``SAMPLE_A_BUCKET`` rows for each part."""
    share = min(1.0, SAMPLE_A_BUCKET * buckets / max(1, rows))
    sample = docs.select("doc_id", "text", "row").sample(fraction=share, seed=5) if share < 1 else docs
    keys = sorted(r[0] for r in sample.select(place_key(F.col("doc_id"), F.xxhash64("text"), F.col("row"))).collect())
    return sorted({keys[len(keys) * k // buckets] for k in range(1, buckets)}) if keys else []


def bucket_of(key: Column, cuts: list[str]) -> Column:
    """How many of the cuts are at most the key: first among every 100th, then among the hundred after it."""
    lots = [" ".join(cuts[a : a + 100]) for a in range(0, len(cuts), 100)]
    if not lots:
        return F.lit(0).cast("long")
    heads = F.split(F.lit(" ".join(cuts[::100])), " ")
    inner = F.split(F.lit("|".join(lots)), "[|]")
    lot = F.size(F.filter(heads, lambda c: c <= key))
    own = F.split(F.element_at(inner, F.greatest(lot, F.lit(1))), " ")
    return F.when(lot == 0, F.lit(0)).otherwise((lot - 1) * 100 + F.size(F.filter(own, lambda c: c <= key))).cast("long")


def with_next(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """doc_id, text, row, bucket, copy: rows dealt to buckets of neighbouring ids, each bucket with a copy of the row after its last.

    Rows are numbered once and written, so that each later pass meets the same numbers. Buckets are cut at quantiles of a sample, at most ``MOST_BUCKETS``, so the cuts and the table of
    buckets' first rows are small at any size. Rows of one id are cut by their texts' hashes, equal
    rows by their numbers. After the last bucket comes the first.
    """
    docs = staged(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    rows = docs.count()
    cuts = cut_keys(docs, max(1, min(MOST_BUCKETS, -(-rows // rows_a_bucket))), rows)
    keyed = docs.withColumn("key", place_key(F.col("doc_id"), F.xxhash64("text"), F.col("row"))).withColumn("bucket", bucket_of(F.col("key"), cuts))
    firsts = keyed.groupBy("bucket").agg(F.min("key").alias("first_key"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = staged(firsts.select(F.col("first_key"), before.alias("before"), F.lit(True).alias("hit")), "bucket-firsts")
    found = keyed.join(F.broadcast(firsts), keyed["key"] == firsts["first_key"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy"))
    homes = F.when(F.col("hit"), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    return found.select("doc_id", "text", "row", F.explode(homes).alias("home")).select("doc_id", "text", "row", "home.bucket", "home.copy")


def fingerprints(docs: DataFrame, *, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last quarter of the code points replaced by as many first ones of the
    next document in ascending order of ids (after the last: the first). Null texts are empty, null
    ids come first, rows with one id in the order of their texts' hashes; a lone document is its own
    next one. An empty table gives an empty result. Other columns are ignored, whatever their names. Very long texts are hashed whole. The part of the
    edited text that is unchanged keeps its windows' picks, only the rest is hashed anew.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "row")
    t = with_next(base).withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.length("text"))
    zero = F.lit(0).cast("long")
    t = t.withColumns({"own_windows": windows(F.col("text"), F.col("n_chars"), zero, k, w), "cut": F.floor(F.col("n_chars") / 4).cast("int")})
    kept = F.greatest(F.col("n_chars") - F.col("cut") - (k + w - 2), F.lit(0))
    t = t.withColumns({"kept": kept, "picks": F.array_distinct("own_windows"), "last_kept": F.get("own_windows", kept - 1), "edited": F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("cut")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("cut")))})
    t = t.withColumns({"own": hashes_of(F.col("picks")), "kept_picks": first_picks(F.col("picks"), F.col("last_kept")), "tail": F.substring("edited", F.col("kept") + 1, F.greatest(F.length("edited") - F.col("kept"), F.lit(0)))})
    t = t.withColumn("after", F.lead("own").over(order)).where(F.col("copy") == 0).withColumn("tail_chars", F.length("tail"))
    rest = F.when((F.col("kept") > 0) & (F.col("tail_chars") < k + w - 1), F.array().cast("array<bigint>")).otherwise(windows(F.col("tail"), F.col("tail_chars"), F.col("kept").cast("long"), k, w))
    t = t.withColumn("edited_picks", F.array_distinct(F.concat("kept_picks", rest)))
    t = t.withColumn("other", hashes_of(F.col("edited_picks")))
    return t.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("picks")).alias("fingerprint"),
        shown(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
