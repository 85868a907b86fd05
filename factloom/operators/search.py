"""Weighted lexical search over findings, and the lines around one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import tokens
from factloom.operators.filters import filter_findings

# Fields of a finding and their weights.
WEIGHTS = {"rule_id": 6, "message": 4, "path": 3, "cwe": 5, "owasp": 5, "snippet": 2, "severity": 1}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyword_hits(findings: DataFrame, query: str) -> DataFrame:
    """Findings with a score over 0, as column ``score``.

    A field of weight w gives 8w for being the query or else 4w for holding it, 6w or 3w for the
    same between their tokens, and w for each of the query's tokens in it; fields missing from
    ``findings`` give nothing. Without all query tokens in the fields together the score is 0.
    """
    fields = [f for f in WEIGHTS if f in findings.columns]
    low = F.lit(query.strip()).cast("string")
    q, q_tokens = F.lower(low), F.array_distinct(tokens(low))
    q_norm = F.array_join(tokens(low), " ")

    def of_field(f: str) -> Column:
        """The field's score and the query's tokens in it, from its text and tokens, which are made once."""
        w = float(WEIGHTS[f])
        flat = lambda norm: F.when(F.size(q_tokens) == 0, 0.0).when(norm == q_norm, 6 * w).when(F.instr(norm, q_norm) > 0, 3 * w).otherwise(0.0)

        def scored(t: Column) -> Column:
            x, hit = t["x"], F.array_intersect(q_tokens, t["own"])
            raw = F.when(x == q, 8 * w).when(F.instr(x, q) > 0, 4 * w).otherwise(0.0)
            return F.struct(F.when(x == "", 0.0).otherwise(raw + let(F.array_join(t["own"], " "), flat) + w * F.size(hit)).alias("score"), hit.alias("hit"))

        text = F.coalesce(F.col(f), F.lit(""))
        return let(F.struct(F.lower(text).alias("x"), tokens(text).alias("own")), scored)

    def whole(parts: Column) -> Column:
        gate = F.size(F.array_except(q_tokens, F.flatten(F.transform(parts, lambda p: p["hit"])))) == 0
        return F.when(gate, F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["score"])).otherwise(0.0)

    score = let(F.array(*(of_field(f) for f in fields)), whole) if fields else F.lit(0.0)
    # A filter would be pushed below the score and make it a second time.
    return findings.select(*(c for c in findings.columns if c != "score"), F.explode(F.filter(F.array(score), lambda x: x > 0)).alias("score"))


def search_page(hits: DataFrame, *, limit: int, offset: int = 0) -> DataFrame:
    severity = F.array_position(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("ERROR")), F.col("severity"))
    return hits.orderBy(F.col("score").desc(), severity.desc(), "path", "start_line", "id").offset(offset).limit(limit)


def search_findings(findings: DataFrame, query: str, *, limit: int, offset: int = 0, least: str = "INFO", rule: str = "", path_glob: str = "") -> DataFrame:
    """A page of the findings that meet the filters, with score; a blank query gives the inventory in its order, each with score 0."""
    rows = filter_findings(findings, least=least, rule=rule, path_glob=path_glob)
    hits = keyword_hits(rows, query) if query.strip() else rows.withColumn("score", F.lit(0.0))
    return search_page(hits, limit=limit, offset=offset)


def context_lines(texts: DataFrame, spots: DataFrame, *, before: int, after: int) -> DataFrame:
    """id, line, shown: the lines around each spot (id, path, at) of ``texts`` (path, text), numbered from 1."""
    near = spots.join(texts, "path").withColumn("_lines", F.split("text", "\n"))
    low, n = F.greatest(F.col("at") - before, F.lit(1)), F.size("_lines")
    high = F.least(F.col("at") + after, n)
    rows = near.where(low <= high).select("id", low.alias("low"), F.posexplode(F.slice("_lines", low, high - low + 1)).alias("_p", "own"))
    line = F.col("low") + F.col("_p")
    return rows.select("id", line.cast("int").alias("line"), F.concat(F.lpad(line.cast("string"), 5, " "), F.lit("| "), "own").alias("shown"))


def severity_counts(findings: DataFrame, by: str) -> DataFrame:
    """Findings by severity or rule_id; other dimensions are refused."""
    if by not in ("severity", "rule_id"):
        raise ValueError(by)
    return findings.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, n: int = 10) -> DataFrame:
    return severity_counts(findings, "rule_id").orderBy(F.col("n").desc(), "value").limit(n)


def finding_summary(findings: DataFrame, rules: int = 10) -> DataFrame:
    """measure, value, n: findings by severity, by the ``rules`` most frequent rules, and by first folder."""
    folder = findings.groupBy(F.lit("folder").alias("measure"), F.substring_index("path", "/", 1).alias("value")).agg(F.count("*").alias("n"))
    severity = severity_counts(findings, "severity").select(F.lit("severity"), "value", "n")
    return severity.union(top_rules(findings, rules).select(F.lit("rule"), "value", "n")).union(folder).toDF("measure", "value", "n")


def first_per_category(rows: DataFrame, category: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each category and whether it has more.

    Each task keeps the first ``n`` and one more of a category, so only these are sent on.
    """
    w = Window.partitionBy(category)
    first = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= n + 1)
    return first.withColumn("truncated", F.max("_n").over(w) > n).where(F.col("_n") <= n).drop("_n")
