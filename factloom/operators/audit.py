"""Audit rules: rows of rule, severity, subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.edges import kafka_edges
from factloom.operators.filters import effective_kafka
from factloom.operators.relations import WRITES
from factloom.plans.traversals import strong_components
from factloom.scratch import staged


def contracts(endpoints: DataFrame) -> DataFrame:
    """topic, producer_types, consumer_types (sorted, joined by a comma), finding: static topics with both sides whose types differ or are known on one side only."""
    return contract_findings(endpoints).drop("members")


def contract_findings(endpoints: DataFrame) -> DataFrame:
    """``contracts`` with members: the modules of the topic, sorted, joined by a blank."""
    t = endpoints.where("system = 'kafka' and not topic_dynamic").groupBy("topic").agg(
        F.max((F.col("role") == "produce").cast("int")).alias("p"),
        F.max((F.col("role") == "consume").cast("int")).alias("c"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "produce", F.col("message_type")))), ",").alias("producer_types"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "consume", F.col("message_type")))), ",").alias("consumer_types"),
        F.array_join(F.array_sort(F.collect_set("module")), " ").alias("members"),
    )
    known_p, known_c = F.col("producer_types") != "", F.col("consumer_types") != ""
    finding = F.when(known_p & known_c & (F.col("producer_types") != F.col("consumer_types")), "mismatch").when(known_p != known_c, "unknown")
    return t.where("p = 1 and c = 1").withColumn("finding", finding).where(F.col("finding").isNotNull()).select("topic", "producer_types", "consumer_types", "finding", "members")


def orphans(endpoints: DataFrame) -> DataFrame:
    """topic, side: effective static topics that are only produced or only consumed."""
    t = effective_kafka(endpoints).where(~F.col("topic_dynamic")).groupBy("topic").agg(F.max((F.col("role") == "produce").cast("int")).alias("p"), F.max((F.col("role") == "consume").cast("int")).alias("c"))
    return t.where("p <> c").select("topic", F.when(F.col("p") == 1, "no consumer").otherwise("no producer").alias("side"))


def orphan_endpoints(endpoints: DataFrame, kafka: DataFrame) -> DataFrame:
    """The static Kafka endpoints whose service has no edge of their topic on their side. ``kafka``: source, target, topic of edges or of their sides."""
    static = endpoints.where("system = 'kafka' and not topic_dynamic and module is not null")
    out = static.where("role = 'produce'").join(kafka.select(F.col("source").alias("module"), "topic").distinct(), ["module", "topic"], "left_anti")
    return out.unionByName(static.where("role = 'consume'").join(kafka.select(F.col("target").alias("module"), "topic").distinct(), ["module", "topic"], "left_anti"))


def orphan_integrations(endpoints: DataFrame) -> DataFrame:
    """kind, name, side: topics and routes, dynamic ones too, that no module of one side has."""
    first = F.col("role").isin("produce", "serve")
    known = F.col("module").isNotNull()
    t = endpoints.groupBy(F.when(F.col("system") == "kafka", "topic").otherwise("api").alias("kind"), F.col("topic").alias("name")).agg(F.max((first & known).cast("int")).alias("p"), F.max((~first & known).cast("int")).alias("c"))
    side = F.when((F.col("p") == 0) & (F.col("c") == 0), "both").when(F.col("p") == 0, F.when(F.col("kind") == "topic", "producer").otherwise("provider")).otherwise("consumer")
    return t.where("p = 0 or c = 0").select("kind", "name", F.concat(F.lit("no "), side).alias("side"))


def idle_module_activity(modules: DataFrame, endpoints: DataFrame, collections: DataFrame) -> DataFrame:
    """module, and how many routes it serves, topics it writes and reads, collections it reads and writes: modules that don't run, aggregators left out.

    ``modules``: identity, kind, starts_application; ``collections``: module, collection, operation.
    """
    quiet = modules.where("not starts_application and kind <> 'aggregator'").select(F.col("identity").alias("module"))
    n = lambda condition, what: F.count_distinct(F.when(condition, F.col(what)))
    e = endpoints.groupBy("module").agg(n(F.col("role") == "serve", "topic").alias("served"), n(F.col("role") == "produce", "topic").alias("published"), n(F.col("role") == "consume", "topic").alias("consumed"))
    writes = F.col("operation").isin(WRITES)
    c = collections.groupBy("module").agg(n(~writes, "collection").alias("read"), n(writes, "collection").alias("written"))
    out = quiet.join(e, "module", "left").join(c, "module", "left").na.fill(0)
    return out.where("served + published + consumed + read + written > 0")


def rest_cycles(edges: DataFrame) -> DataFrame:
    """a, b: services that call each other, each pair once."""
    e = edges.select("source", "target").distinct()
    back = e.select(F.col("source").alias("target"), F.col("target").alias("source"))
    return e.join(back, ["source", "target"]).where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b"))


# How sure a rule is, where it isn't high.
CONFIDENCE = {"kafka-message-contract-mismatch": "medium", "kafka-message-contract-unknown": "medium", "event-dependency-cycle": "medium"}


def audit(endpoints: DataFrame, rest: DataFrame, inside: DataFrame, *, kafka: DataFrame | None = None, idle: DataFrame | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """rule, severity, subject, services, evidence, confidence of all findings, each once.

    ``rest`` and ``kafka`` are service edges, ``inside`` calls in consumers, ``idle`` activity of
    modules that don't run, ``cycles`` (component, services, path) cycles of messages. The subject is
    the endpoint, topic, pair or module that a rule is about; the evidence its place or its names.
    """
    if kafka is None:
        kafka = kafka_edges(endpoints)
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"))
    service = F.coalesce("module", F.lit(""))

    def issue(rule, subject, services, evidence, severity: str = "WARNING") -> Column:
        rule = F.lit(rule) if isinstance(rule, str) else rule
        sure = F.lit("high")
        for name, value in CONFIDENCE.items():
            sure = F.when(rule == name, value).otherwise(sure)
        return F.struct(rule.alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"), services.alias("services"), evidence.alias("evidence"), sure.alias("confidence"))

    def rows(df: DataFrame, *issues: Column) -> DataFrame:
        return df.select(F.explode(F.array_compact(F.array(*issues))).alias("x")).select("x.*")

    # One pass over endpoints: the rules on single ones, and those of a side of an edge that is lacking.
    ends = kafka.select(F.explode(F.array(F.struct(F.col("source").alias("_m"), F.lit("produce").alias("_r")), F.struct(F.col("target").alias("_m"), F.lit("consume").alias("_r")))).alias("x"), F.col("topic").alias("_t")).select("x.*", "_t").distinct()
    own = endpoints.select("id", "role", "system", "topic", "topic_dynamic", "path", "start_line", "module").distinct()
    linked = own.join(ends.withColumn("_linked", F.lit(True)), (F.col("module") == F.col("_m")) & (F.col("role") == F.col("_r")) & (F.col("topic") == F.col("_t")), "left")
    on_kafka, dynamic = F.col("system") == "kafka", F.col("topic_dynamic")
    alone = on_kafka & ~dynamic & F.col("module").isNotNull() & F.col("_linked").isNull()
    both = F.concat("a", F.lit(" "), "b")
    types = F.concat(F.lit("writes "), F.col("producer_types"), F.lit(", reads "), F.col("consumer_types"))
    parts = [
        rows(
            linked,
            F.when(on_kafka & dynamic, issue("dynamic-kafka-topic", F.col("id"), service, place)),
            F.when((F.col("system") == "rest") & (F.col("role") == "call") & F.endswith("topic", F.lit(" <dynamic>")), issue("dynamic-http-target", F.col("id"), service, place)),
            F.when(alone, issue(F.when(F.col("role") == "produce", "orphan-kafka-producer").otherwise("orphan-kafka-consumer"), F.col("id"), service, F.concat("topic", F.lit(" "), place))),
        ),
        rows(contract_findings(endpoints), issue(F.concat(F.lit("kafka-message-contract-"), F.col("finding")), F.col("topic"), F.col("members"), types)),
        rows(rest_cycles(rest), issue("synchronous-rest-cycle", both, both, both, "ERROR")),
        rows(inside.select("consumer_id", "call_id", "module", "path").distinct(), issue("synchronous-http-in-kafka-consumer", F.concat("consumer_id", F.lit(" "), "call_id"), F.coalesce("module", F.lit("")), F.col("path"))),
    ]
    if idle is not None:
        counts = F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("served", "published", "consumed", "read", "written")))
        parts.append(rows(idle, issue("non-runtime-module-activity", F.col("module"), F.col("module"), counts)))
    if cycles is not None:
        parts.append(rows(cycles, issue("event-dependency-cycle", F.col("component"), F.col("services"), F.col("path"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_cycle_rows(edges: DataFrame, kinds: DataFrame, *, shown: int = 20) -> DataFrame:
    """component, services, path of the cycles that ``traversals.event_cycles`` finds: the first ``shown`` services and nodes by name, and how many more there are.

    A component may hold a large part of the graph, so its names are never gathered: the first ones are
    ranked, which each task does with those that it has.
    """
    c = staged(strong_components(edges).join(kinds.select("node", "kind").distinct(), "node"), "cycle-nodes")
    is_service = F.col("kind") == "service"
    totals = c.groupBy("component").agg(F.count("*").alias("nodes"), F.count(F.when(is_service, 1)).alias("of_service"), F.count(F.when(F.col("kind") == "topic", 1)).alias("of_topic")).where("nodes >= 3 and of_service >= 2 and of_topic >= 1")

    def listed(rows: DataFrame, name: str, between: str) -> DataFrame:
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("_n") <= shown)
        return first.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), between).alias(name))

    def more(total: str, between: str) -> Column:
        return F.when(F.col(total) > shown, F.concat(F.lit(f"{between}and "), (F.col(total) - shown).cast("string"), F.lit(" more"))).otherwise("")

    out = totals.join(listed(c.where(is_service), "names", " "), "component").join(listed(c, "way", " -> "), "component")
    return out.select("component", F.concat("names", more("of_service", " ")).alias("services"), F.concat("way", more("nodes", " -> ")).alias("path"))


def in_order(issues: DataFrame) -> DataFrame:
    """Findings by severity, rule and evidence, as a report lists them; a sort of all rows, for listings only."""
    return issues.orderBy("severity", "rule", "evidence", "subject")
