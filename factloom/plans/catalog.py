"""Catalogue views: what a service, topic, route or message type is connected to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.filters import exportable, first_per_key, resolve_names
from factloom.operators.search import first_per_category


def _names(condition, column: str) -> F.Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col(column)))), ",")


def topic_summary(endpoints: DataFrame) -> DataFrame:
    """topic, producers, consumers, message_types, dynamic of each topic."""
    k = endpoints.where("system = 'kafka'")
    return k.groupBy("topic").agg(
        _names(F.col("role") == "produce", "module").alias("producers"),
        _names(F.col("role") == "consume", "module").alias("consumers"),
        _names(F.lit(True), "message_type").alias("message_types"),
        F.max("topic_dynamic").alias("dynamic"),
    )


def api_summary(endpoints: DataFrame) -> DataFrame:
    """api, providers, callers of each route."""
    r = endpoints.where("system = 'rest'")
    return r.groupBy(F.col("topic").alias("api")).agg(F.count_distinct(F.when(F.col("role") == "serve", F.col("module"))).alias("providers"), F.count_distinct(F.when(F.col("role") == "call", F.col("module"))).alias("callers"))


def dto_summary(endpoints: DataFrame, runtime: DataFrame) -> DataFrame:
    """dto, topics, producers, consumers, of runtime modules only."""
    e = endpoints.where("system = 'kafka' and message_type is not null").join(runtime.select("module").distinct(), "module", "left_semi")
    return e.groupBy(F.col("message_type").alias("dto")).agg(F.count_distinct("topic").alias("topics"), F.count_distinct(F.when(F.col("role") == "produce", F.col("module"))).alias("producers"), F.count_distinct(F.when(F.col("role") == "consume", F.col("module"))).alias("consumers"))


def module_summary(endpoints: DataFrame, dependencies: DataFrame, rest: DataFrame) -> DataFrame:
    """module and how many routes it serves and calls, topics it writes and reads, types, modules in and out, unmatched calls."""
    d = lambda c: F.count_distinct(c)
    e = endpoints.where(F.col("module").isNotNull())
    matched = rest.select(F.col("call_id").alias("_c"), F.col("source").alias("_s")).distinct()
    calls = e.where("role = 'call'").join(matched, (F.col("id") == F.col("_c")) & (F.col("module") == F.col("_s")), "left_anti")
    external = calls.groupBy("module").agg(d("topic").alias("external_apis"))
    out = e.groupBy("module").agg(d(F.when(F.col("role") == "serve", F.col("topic"))).alias("served"), d(F.when(F.col("role") == "call", F.col("topic"))).alias("called"), d(F.when(F.col("role") == "produce", F.col("topic"))).alias("produced"), d(F.when(F.col("role") == "consume", F.col("topic"))).alias("consumed"), d("message_type").alias("types"))
    deps = dependencies.groupBy(F.col("source").alias("module")).agg(d("target").alias("depends_on"))
    used = dependencies.groupBy(F.col("target").alias("module")).agg(d("source").alias("used_by"))
    for more in (deps, used, external):
        out = out.join(more, "module", "left")
    return out.na.fill(0)


def neighbours(endpoints: DataFrame, dependencies: DataFrame) -> DataFrame:
    """kind, name, relation, other_kind, other: direct neighbours of every module, topic and route, distinct."""
    e = endpoints.where(F.col("module").isNotNull()).select("module", "system", "role", "topic", "message_type")
    thing = F.when(F.col("system") == "kafka", "topic").otherwise("api")
    verb = F.when(F.col("role") == "produce", "publishes").when(F.col("role") == "consume", "consumes").when(F.col("role") == "serve", "provides").otherwise("calls")
    noun = F.when(F.col("role") == "produce", "producer").when(F.col("role") == "consume", "consumer").when(F.col("role") == "serve", "provider").otherwise("consumer")
    sides = F.explode(F.array(F.struct(F.lit("module").alias("kind"), F.col("module").alias("name"), verb.alias("relation"), thing.alias("other_kind"), F.col("topic").alias("other")), F.struct(thing.alias("kind"), F.col("topic").alias("name"), noun.alias("relation"), F.lit("module").alias("other_kind"), F.col("module").alias("other"))))
    own = e.select(sides.alias("x")).select("x.*")
    deps = dependencies.select(F.explode(F.array(F.struct(F.lit("module").alias("kind"), F.col("source").alias("name"), F.lit("depends_on").alias("relation"), F.lit("module").alias("other_kind"), F.col("target").alias("other")), F.struct(F.lit("module").alias("kind"), F.col("target").alias("name"), F.lit("used_by").alias("relation"), F.lit("module").alias("other_kind"), F.col("source").alias("other")))).alias("x")).select("x.*")
    return own.union(deps).distinct()


def coverage(endpoints: DataFrame, relations: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """measure, value, n: endpoints by role and system, relations by type and by confidence, in one long table.

    ``messages`` (source, targets) counts relations ``publishes_to`` that ``relations`` hasn't.
    """
    e = endpoints.groupBy(F.lit("endpoints").alias("measure"), F.concat("system", F.lit(" "), "role").alias("value")).agg(F.count("*").alias("n"))
    r = relations.groupBy("relation", "confidence").agg(F.count("*").alias("n"))
    if messages is not None:
        r = r.union(messages.agg(F.sum("targets").alias("n")).where("n > 0").select(F.lit("publishes_to"), F.lit("high"), "n"))
    side = lambda name, column: F.struct(F.lit(name).alias("measure"), F.col(column).alias("value"), "n")
    both = r.select(F.explode(F.array(side("relations", "relation"), side("confidence", "confidence"))).alias("x")).select("x.*")
    return e.union(both.groupBy("measure", "value").agg(F.sum("n").alias("n")))


def issues(endpoints: DataFrame, calls: DataFrame, rest: DataFrame) -> DataFrame:
    """code, severity, n: dynamic topics, unknown message types, and HTTP calls without an edge."""
    k = endpoints.where("system = 'kafka'")
    matched = rest.select("call_id").distinct()
    open_calls = calls.join(matched, calls["id"] == matched["call_id"], "left_anti")
    ambiguous = F.col("status") == "ambiguous"
    parts = [
        k.where("topic_dynamic").select(F.lit("dynamic_kafka_topic").alias("code"), F.lit("warning").alias("severity"), "id"),
        k.where("message_type is null").select(F.lit("unknown_kafka_message_type"), F.lit("info"), "id"),
        open_calls.select(F.when(ambiguous, "ambiguous_http_target").otherwise("unmatched_http_call"), F.when(ambiguous | F.col("topic_dynamic"), "warning").otherwise("info"), "id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("code", "severity").agg(F.count("*").alias("n"))


def dependency_edges(endpoints: DataFrame, rest: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """source, target, kind, label, confidence of the dependency graph, distinct.

    Dynamic topics are nodes of their own service. Calls that no edge matches go to external routes.
    """
    k = endpoints.where("system = 'kafka'")
    node = F.when(F.col("topic_dynamic"), F.concat("module", F.lit(":"), "topic")).otherwise(F.col("topic"))
    sure = F.when(F.col("topic_dynamic"), "medium").otherwise("high")
    out = F.col("role") == "produce"
    verb = F.when(out, "publishes").otherwise("consumes")
    typed = F.concat(verb, F.coalesce(F.concat(F.lit(" "), "message_type"), F.lit("")))
    matched = rest.select("call_id").distinct()
    calls = endpoints.where("system = 'rest' and role = 'call'")
    open_calls = calls.join(matched, calls["id"] == matched["call_id"], "left_anti")
    parts = [
        rest.select("source", "target", F.lit("http").alias("kind"), F.concat("target", F.lit(": "), "serve").alias("label"), F.lit("high").alias("confidence")),
        k.select(F.when(out, F.col("module")).otherwise(node), F.when(out, node).otherwise(F.col("module")), verb, typed, sure),
        open_calls.select("module", "topic", F.lit("calls_external"), F.col("topic"), sure),
    ]
    if collections is not None:
        parts.append(collections.select("module", F.concat("module", F.lit(":"), "collection"), F.lit("uses"), F.lit("uses"), F.lit("high")))
    graph = parts[0]
    for p in parts[1:]:
        graph = graph.union(p)
    return graph.distinct()


def merge_facts(nodes: DataFrame, edges: DataFrame, fact_nodes: DataFrame, fact_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph nodes (id) and edges (source, target, kind) with facts added where they are missing, ends included."""
    more = fact_edges.join(edges, ["source", "target", "kind"], "left_anti").select("source", "target", "kind").distinct()
    all_edges = edges.select("source", "target", "kind").union(more)
    ends = more.select(F.col("source").alias("id")).union(more.select(F.col("target").alias("id")))
    return nodes.select("id").union(fact_nodes.select("id")).union(ends).distinct(), all_edges


def federate(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several services' inventories under ids of their own; a repeated id stays once."""
    out = None
    for service, df in parts.items():
        own = df.withColumn("id", F.concat(F.lit(f"{service}:"), "id")).withColumn("service", F.lit(service))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.dropDuplicates(["id"])


KINDS = ["microservice", "module", "topic", "api", "collection", "dto", "endpoint"]
ALIASES = {"service": "microservice", "microservices": "microservice", "services": "microservice", "modules": "module", "topics": "topic", "apis": "api", "route": "api", "routes": "api", "collections": "collection", "dtos": "dto", "endpoints": "endpoint"}


def kind_of(name: str) -> str:
    """The kind that a name or its plural stands for."""
    low = name.strip().lower()
    return ALIASES.get(low, low)


def list_objects(kind: str, endpoints: DataFrame, modules: DataFrame, collections: DataFrame) -> DataFrame:
    """kind, name: all objects of a kind, each once; of an unknown kind none. ``modules``: identity, starts_application; ``collections``: collection."""
    kind = kind_of(kind)
    names = {
        "microservice": lambda: modules.where("starts_application").select("identity"),
        "module": lambda: modules.select("identity"),
        "topic": lambda: endpoints.where("system = 'kafka'").select("topic"),
        "api": lambda: endpoints.where("system = 'rest'").select("topic"),
        "collection": lambda: collections.select("collection"),
        "dto": lambda: endpoints.where("system = 'kafka' and message_type <> ''").select("message_type"),
        "endpoint": lambda: endpoints.select("id"),
    }
    found = names[kind]() if kind in names else modules.select("identity").limit(0)
    return found.distinct().select(F.lit(kind).alias("kind"), F.col(found.columns[0]).alias("name"))


def show_objects(wanted: DataFrame, near: DataFrame) -> DataFrame:
    """The neighbours of each wanted object (kind, name); objects that aren't known give no row."""
    return near.join(wanted.select("kind", "name").distinct(), ["kind", "name"])


def external_apis(endpoints: DataFrame, rest: DataFrame) -> DataFrame:
    """module, api: routes that a module calls and no edge of its own matches."""
    matched = rest.select(F.col("call_id").alias("_c"), F.col("source").alias("_s")).distinct()
    calls = endpoints.where("system = 'rest' and role = 'call' and module is not null")
    return calls.join(matched, (F.col("id") == F.col("_c")) & (F.col("module") == F.col("_s")), "left_anti").select("module", F.col("topic").alias("api")).distinct()


def collection_summary(collections: DataFrame, modules: DataFrame) -> DataFrame:
    """collection, modules, services (runtime modules only; both sorted, by comma) and the number of its operations."""
    m = modules.select(F.col("identity").alias("module"), "starts_application")
    return collections.join(m, "module").groupBy("collection").agg(_names(F.lit(True), "module").alias("modules"), _names(F.col("starts_application"), "module").alias("services"), F.count("*").alias("operations"))


def collection_access(collections: DataFrame, writes: list[str]) -> DataFrame:
    """node, module, collection, access: reads or writes of collections, as nodes of their services."""
    way = F.when(F.col("operation").isin(writes), "writes").otherwise("reads")
    return collections.select(F.concat("module", F.lit(":"), "collection").alias("node"), "module", "collection", way.alias("access")).distinct()


def module_lists(endpoints: DataFrame) -> DataFrame:
    """module, and what it serves, calls, publishes and consumes, sorted and joined by commas."""
    e = endpoints.where(F.col("module").isNotNull())
    sides = {"served": "serve", "called": "call", "published": "produce", "consumed": "consume"}
    return e.groupBy("module").agg(*(_names(F.col("role") == role, "topic").alias(name) for name, role in sides.items()))


def flow_sites(asked: DataFrame, endpoints: DataFrame) -> DataFrame:
    """query, topic, service, id, role: where the topic or route that a query names is used; the query is exact or in one name only."""
    found = resolve_names(asked, endpoints.select(F.col("topic").alias("name"))).where("resolved is not null").select("query", F.col("resolved").alias("topic"))
    return endpoints.join(found, "topic").select("query", "topic", F.coalesce("module", F.lit("")).alias("service"), "id", "role").distinct()


def visual_edges(endpoints: DataFrame) -> DataFrame:
    """source, target, relation, evidence: one link of a service and a topic, with the strongest of its evidence: dynamic, manifest, code."""
    k = endpoints.where("system = 'kafka' and module is not null")
    out = F.col("role") == "produce"
    links = k.groupBy(F.when(out, F.col("module")).otherwise(F.col("topic")).alias("source"), F.when(out, F.col("topic")).otherwise(F.col("module")).alias("target"), F.when(out, "publishes").otherwise("consumes").alias("relation"))
    t = links.agg(F.max("topic_dynamic").alias("d"), F.max(F.col("source") == "manifest").alias("m"))
    return t.select("source", "target", "relation", F.when(F.col("d"), "dynamic").when(F.col("m"), "manifest").otherwise("code").alias("evidence"))


def graph_totals(graph: DataFrame) -> DataFrame:
    """measure, n: nodes, links, and links by kind and confidence of a dependency graph."""
    # One pass over the graph: its links and their ends are counted by kind and confidence, or by node, and these counts are added up.
    of = lambda *values: F.struct(*(v.alias(c) for v, c in zip(values, ("node", "kind", "confidence"), strict=True)))
    nothing = F.lit(None).cast("string")
    each = F.array(of(nothing, F.col("kind"), F.col("confidence")), of(F.col("source"), nothing, nothing), of(F.col("target"), nothing, nothing))
    counted = graph.select(F.posexplode(each).alias("at", "x")).groupBy((F.col("at") == 0).alias("link"), "x").agg(F.count("*").alias("n"))
    measure = lambda name, n: F.struct(name.alias("measure"), n.alias("n"))
    links = F.array(measure(F.lit("links"), F.col("n")), measure(F.concat(F.lit("kind "), "x.kind"), F.col("n")), measure(F.concat(F.lit("confidence "), "x.confidence"), F.col("n")))
    rows = counted.select(F.explode(F.when(F.col("link"), links).otherwise(F.array(measure(F.lit("nodes"), F.lit(1).cast("long"))))).alias("m")).select("m.*")
    none = graph.sparkSession.createDataFrame([("nodes", 0), ("links", 0)], "measure string, n long")
    return rows.union(none).groupBy("measure").agg(F.sum("n").alias("n"))


def endpoints_by_module(endpoints: DataFrame, *, keep_null: bool = False) -> DataFrame:
    """module, n; endpoints without a module are left out or, with ``keep_null``, a group of their own."""
    return (endpoints if keep_null else endpoints.where(F.col("module").isNotNull())).groupBy("module").agg(F.count("*").alias("n"))


def unresolved_samples(endpoints: DataFrame, rest: DataFrame, n: int = 20) -> DataFrame:
    """category, id, module, topic, path, start_line, truncated: the first ``n`` dynamic topics, topics of unknown type and unmatched calls by place."""
    calls = endpoints.where("system = 'rest' and role = 'call'").join(rest.select(F.col("call_id").alias("id")).distinct(), "id", "left_anti")
    order = ["path", "start_line", "id"]
    # Each category keeps its first rows without a sort of all of them.
    own = lambda df, name: df.select(F.lit(name).alias("category"), "id", "module", "topic", "path", "start_line").orderBy(*order).limit(n + 1)
    k = endpoints.where("system = 'kafka'")
    every = own(k.where("topic_dynamic"), "dynamic_kafka_topics").union(own(k.where("message_type is null"), "unknown_kafka_message_types")).union(own(calls, "unmatched_http_calls"))
    return first_per_category(every, "category", order, n)


def deployable(endpoints: DataFrame, modules: DataFrame) -> DataFrame:
    """service: services of endpoints that no local module is, or whose module starts an application, by exportable names."""
    m = modules.select(F.col("identity").alias("service"), "starts_application")
    names = endpoints.where(F.col("module").isNotNull()).select(F.col("module").alias("service")).distinct()
    return names.join(m, "service", "left").where((F.col("starts_application").isNull() | F.col("starts_application")) & exportable(F.col("service"))).select("service")


def module_by_reference(asked: DataFrame, modules: DataFrame) -> DataFrame:
    """reference, identity: the module of that identity, else the only one of that display name, else null."""
    exact = modules.select(F.col("identity").alias("reference"), F.col("identity").alias("_exact"))
    named = modules.groupBy(F.col("name").alias("reference")).agg(F.count("*").alias("_n"), F.min("identity").alias("_only")).where("_n = 1").drop("_n")
    return asked.select("reference").distinct().join(exact, "reference", "left").join(named, "reference", "left").select("reference", F.coalesce("_exact", "_only").alias("identity"))


def workload_modules(workloads: DataFrame, modules: DataFrame) -> DataFrame:
    """All workloads (workload, ...) with the module of exactly that name, null if none."""
    return workloads.join(modules.select(F.col("name").alias("workload"), F.col("identity").alias("module")), "workload", "left")


def federated(rows: DataFrame, services: DataFrame) -> DataFrame:
    """Rows of many local inventories (column service) in one: ids get their service before them, and a service's own local name becomes the service.

    ``services``: service, local (its own identity in its inventory). Columns module, source_name and
    target_name are rewritten where they are; names of relations only where their kind is a microservice.
    Of rows with one id the first in order of all columns stays.
    """
    out = rows.join(services.select("service", F.col("local").alias("_local")), "service", "left")
    out = out.withColumn("id", F.concat("service", F.lit(":"), "id"))
    for name, kind in (("module", None), ("source_name", "source_kind"), ("target_name", "target_kind")):
        if name in rows.columns:
            own = F.col(name) == F.col("_local")
            own = own & (F.col(kind) == "microservice") if kind else own
            out = out.withColumn(name, F.when(own, F.col("service")).otherwise(F.col(name)))
    out = out.drop("_local")
    return first_per_key(out, ["id"], [F.col(c).asc_nulls_first() for c in sorted(set(out.columns) - {"id"})])


def federation_warnings(services: DataFrame, indexed: DataFrame) -> DataFrame:
    """service, warning: runtime services (service, kind) that a federation lacks; edges are derived from the others alone."""
    lacking = services.where("kind = 'microservice'").join(indexed.select("service").distinct(), "service", "left_anti")
    return lacking.select("service", F.lit("not indexed: dependencies are partial").alias("warning"))


def workspace_services(modules: DataFrame) -> DataFrame:
    """service, kind: modules but aggregators as services; a module that starts no application is a shared one."""
    return modules.where("kind <> 'aggregator'").select(F.col("identity").alias("service"), F.when(F.col("starts_application"), "microservice").otherwise("shared-module").alias("kind"))


def api_names(endpoints: DataFrame) -> DataFrame:
    """api, providers, callers of each route: the modules, sorted, by comma."""
    r = endpoints.where("system = 'rest' and module is not null")
    return r.groupBy(F.col("topic").alias("api")).agg(_names(F.col("role") == "serve", "module").alias("providers"), _names(F.col("role") == "call", "module").alias("callers"))


def dto_names(endpoints: DataFrame, runtime: DataFrame) -> DataFrame:
    """dto, topics, producers, consumers of each message type: names, sorted, by comma, of runtime modules only."""
    e = endpoints.where("system = 'kafka' and message_type is not null").join(runtime.select("module").distinct(), "module", "left_semi")
    return e.groupBy(F.col("message_type").alias("dto")).agg(_names(F.lit(True), "topic").alias("topics"), _names(F.col("role") == "produce", "module").alias("producers"), _names(F.col("role") == "consume", "module").alias("consumers"))


def topic_types(endpoints: DataFrame) -> DataFrame:
    """topic, published, consumed: the message types of a topic by side, sorted, by comma; topics without a known type have no row."""
    typed = endpoints.where("system = 'kafka' and message_type <> ''")
    return typed.groupBy("topic").agg(_names(F.col("role") == "produce", "message_type").alias("published"), _names(F.col("role") == "consume", "message_type").alias("consumed"))


def object_neighbours(endpoints: DataFrame, dependencies: DataFrame, collections: DataFrame) -> DataFrame:
    """kind, name, relation, other_kind, other: ``neighbours``, and those of message types, endpoints and collections, distinct.

    ``collections``: module, collection. A message type is near to the topics that carry it and to the
    modules at their ends, an endpoint to its module and what it implements, a collection to its users.
    """
    out_side = F.col("role") == "produce"
    thing = F.when(F.col("system") == "kafka", "topic").otherwise("api")

    def near(condition, kind: str, name: Column, relation, other_kind, other: Column) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), name.alias("name"), lit(relation).alias("relation"), lit(other_kind).alias("other_kind"), other.alias("other")))

    typed = (F.col("system") == "kafka") & (F.col("message_type") != "")
    known = F.col("module").isNotNull()
    rows = endpoints.select("id", "module", "system", "role", "topic", "message_type").select(
        F.explode(
            F.array_compact(
                F.array(
                    near(typed, "dto", F.col("message_type"), F.when(out_side, "published_as").otherwise("consumed_as"), "topic", F.col("topic")),
                    near(typed & known, "dto", F.col("message_type"), F.when(out_side, "producer").otherwise("consumer"), "module", F.col("module")),
                    near(known, "endpoint", F.col("id"), "belongs_to", "module", F.col("module")),
                    near(F.lit(True), "endpoint", F.col("id"), "implements", thing, F.col("topic")),
                )
            )
        ).alias("x")
    )
    uses = collections.select(F.explode(F.array(near(F.lit(True), "module", F.col("module"), "uses", "collection", F.col("collection")), near(F.lit(True), "collection", F.col("collection"), "uses", "module", F.col("module")))).alias("x"))
    return neighbours(endpoints, dependencies).union(rows.select("x.*").union(uses.select("x.*")).distinct())


def impacts(near: DataFrame) -> DataFrame:
    """kind, name, direct, kinds: how many neighbours (rows of ``neighbours``) an object has, and of how many kinds."""
    return near.groupBy("kind", "name").agg(F.count("*").alias("direct"), F.count_distinct("other_kind").alias("kinds"))


def implementations(endpoints: DataFrame, ids: DataFrame) -> DataFrame:
    """Endpoints of the given ids (id) with their evidence as one struct."""
    evidence = F.struct("path", "start_line", "end_line", (F.col("qualified_name") if "qualified_name" in endpoints.columns else F.lit(None).cast("string")).alias("qualified_name"), "snippet")
    return endpoints.join(ids.select("id").distinct(), "id", "left_semi").select(F.lit("integration").alias("kind"), "id", F.col("topic").alias("name"), "role", "system", "module", "message_type", evidence.alias("implementation"))


def node_id(kind: Column, name: Column, service: Column | None = None) -> Column:
    """``kind[:service]:name``; without a service, or with a null one, its part is left out."""
    return F.concat_ws(":", kind, service, name) if service is not None else F.concat_ws(":", kind, name)


def known_services(endpoints: DataFrame, modules: DataFrame) -> DataFrame:
    """service: modules of endpoints and declared modules (identity)."""
    return endpoints.where("module is not null").select(F.col("module").alias("service")).union(modules.select("identity")).distinct()


def graph_nodes(graph: DataFrame, services: DataFrame) -> DataFrame:
    """kind, service, name, id of the nodes of ``dependency_edges``: microservices, topics (a dynamic one belongs to its service) and external services, in no order."""
    ends = graph.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(True).alias("first"), F.col("kind")), F.struct(F.col("target").alias("node"), F.lit(False).alias("first"), F.col("kind")))).alias("x")).select("x.*")
    on_topic = F.when(F.col("kind") == "publishes", ~F.col("first")).when(F.col("kind") == "consumes", F.col("first")).otherwise(F.lit(False))
    kind = F.when(on_topic, "topic").when((F.col("kind") == "calls_external") & ~F.col("first"), "external_service").otherwise("microservice")
    nodes = ends.select(kind.alias("kind"), "node").distinct().withColumn("_first", F.substring_index("node", ":", 1))
    own = services.select(F.col("service").alias("_first")).distinct().withColumn("_known", F.lit(True))
    found = nodes.join(own, "_first", "left")
    local = (F.col("kind") == "topic") & F.col("_known") & F.contains("node", F.lit(":"))
    service = F.when(local, F.col("_first"))
    name = F.when(local, F.expr("substr(node, length(_first) + 2)")).otherwise(F.col("node"))
    return found.select("kind", service.alias("service"), name.alias("name")).withColumn("id", node_id(F.col("kind"), F.col("name"), F.col("service")))


def issues_in_order(found: DataFrame) -> DataFrame:
    """Issues (severity, code, message) with warnings first, then by code and message."""
    return found.orderBy(F.when(F.col("severity") == "warning", 0).otherwise(1), "code", "message")


def nodes_in_order(nodes: DataFrame) -> DataFrame:
    """Nodes by kind, service (none first) and name, as a graph lists them."""
    return nodes.orderBy("kind", F.coalesce("service", F.lit("")), "name")


def edges_in_order(graph: DataFrame) -> DataFrame:
    """Edges by source, target, kind and label, as a graph lists them."""
    return graph.orderBy("source", "target", "kind", "label")


# How sure a link's evidence makes it, the strongest first.
EVIDENCE = ["strategy1", "openapi", "dynamic", "manifest", "code"]


def link_evidence(flags: dict[str, Column]) -> Column:
    """The first of ``EVIDENCE`` whose flag is set for any row of a group; code without one."""
    out = F
    for name in EVIDENCE[:-1]:
        if name in flags:
            out = out.when(F.max(F.coalesce(flags[name], F.lit(False))), name)
    return out.otherwise(EVIDENCE[-1])


def service_links(endpoints: DataFrame, *, conventions: Column | None = None) -> DataFrame:
    """source, target, relation, evidence of every link of a module and a topic or route, by all five kinds of evidence.

    Endpoints of source ``openapi`` are those of declared contracts;
    ``conventions`` marks endpoints that follow naming conventions only.
    """
    e = endpoints.where("module is not null")
    out = F.col("role").isin("produce", "call")
    verb = F.when(F.col("role") == "produce", "publishes").when(F.col("role") == "consume", "consumes").when(F.col("role") == "serve", "provides").otherwise("calls")
    flags = {"openapi": F.col("source") == "openapi", "dynamic": F.col("topic_dynamic"), "manifest": F.col("source") == "manifest"}
    if conventions is not None:
        flags["strategy1"] = conventions
    links = e.groupBy(F.when(out, F.col("module")).otherwise(F.col("topic")).alias("source"), F.when(out, F.col("topic")).otherwise(F.col("module")).alias("target"), verb.alias("relation"))
    return links.agg(link_evidence(flags).alias("evidence"))


FACT_FIELDS = ["technology", "layer", "status"]


def merged_nodes(nodes: DataFrame, known_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the nodes of a graph with what facts say of them; id, field, kept, other where the two origins differ).

    ``nodes``: kind, name, label and, as far as known, technology, layer, status; ``known_facts``: kind,
    name, namespace, technology, layer, status and ``at``, their order. Both are one node where kind and
    name agree; a fact's kind ``service`` is a microservice. A label stays the graph's, or is the name of
    a node that only facts have. Technology and layer are the last fact's that has them, else the graph's;
    the status is the graph's, and of a new node its first fact's. Namespaces of facts are listed, sorted, for
    microservices. One aggregation over both origins, none of them gathered.
    """
    own = nodes.select(node_id(F.col("kind"), F.col("name")).alias("id"), "kind", "name", "label", *FACT_FIELDS, F.lit(None).cast("string").alias("namespace"), F.lit(None).cast("long").alias("at"))
    kind = F.when(F.col("kind") == "service", "microservice").otherwise(F.col("kind"))
    told = known_facts.where("name is not null").select(node_id(kind, F.col("name")).alias("id"), kind.alias("kind"), "name", F.lit(None).cast("string").alias("label"), *FACT_FIELDS, "namespace", F.col("at").cast("long").alias("at"))
    fact = F.col("at").isNotNull()

    def last(field: str) -> Column:
        has = fact & F.col(field).isNotNull() & (F.col(field) != "")
        return F.max_by(F.when(has, F.col(field)), F.when(has, F.struct("at", field)))

    graphs = lambda field: F.max(F.when(~fact, F.col(field)))
    both = own.unionByName(told).groupBy("id").agg(
        F.max("kind").alias("kind"),
        F.max("name").alias("name"),
        F.max("label").alias("label"),
        F.max(~fact).alias("_in_graph"),
        *(graphs(f).alias(f"_graph_{f}") for f in FACT_FIELDS),
        *(last(f).alias(f"_fact_{f}") for f in FACT_FIELDS),
        F.min_by("status", F.when(fact, F.struct("at", "status"))).alias("_first_status"),
        F.array_join(F.array_sort(F.collect_set("namespace")), ",").alias("_namespaces"),
    )
    picked = {f: F.coalesce(f"_fact_{f}", f"_graph_{f}") for f in ("technology", "layer")} | {"status": F.when(F.col("_in_graph"), F.col("_graph_status")).otherwise(F.col("_first_status"))}
    spaces = F.when(F.col("kind") == "microservice", F.col("_namespaces")).otherwise("")
    merged = both.select("id", "kind", "name", F.coalesce("label", "name").alias("label"), *(c.alias(f) for f, c in picked.items()), spaces.alias("namespaces"))
    differ = [F.when(F.col("_in_graph") & (F.col(f"_graph_{f}") != F.col(f"_fact_{f}")), F.struct(F.lit(f).alias("field"), picked[f].alias("kept"), (F.col("_graph_" + f) if f != "status" else F.col("_fact_" + f)).alias("other"))) for f in FACT_FIELDS]
    conflicts = both.select("id", F.explode(F.array_compact(F.array(*differ))).alias("x")).select("id", "x.*")
    return merged, conflicts


def complexity_details(links: DataFrame, services: DataFrame, found: DataFrame) -> DataFrame:
    """service, relations, findings, summary: at how many ends of links a service stands, and its findings by severity, worst first.

    ``links``: distinct source, target and whatever tells links apart; ``services``: service; ``found``:
    service, severity. A link from a service to itself counts twice. Services without any are listed.
    """
    ends = links.select(F.explode(F.array("source", "target")).alias("service")).groupBy("service").agg(F.count("*").alias("relations"))
    levels = ("ERROR", "WARNING", "INFO")
    counts = found.groupBy("service").agg(F.count("*").alias("findings"), *(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in levels))
    told = F.concat_ws(", ", *(F.when(F.col(s) > 0, F.concat(F.lit(f"{s}="), F.col(s).cast("string"))) for s in levels))
    out = services.select("service").distinct().join(ends, "service", "left").join(counts, "service", "left").na.fill(0)
    return out.select("service", "relations", "findings", F.when(told == "", "none").otherwise(told).alias("summary"))


def service_cards(endpoints: DataFrame, modules: DataFrame, relations: DataFrame | None, collections: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """module, kind, databases, technologies, outgoing, incoming (all lists sorted, by comma) of every module (identity, starts_application).

    Databases are the collections that a module uses. Every module is Java; one that starts is Spring Boot, one that writes or
    reads topics Kafka, one with collections MongoDB. Outgoing and incoming are the microservices of service relations, or
    ``near`` (module, outgoing, incoming) has these lists.
    """
    m = modules.select(F.col("identity").alias("module"), "starts_application")
    k = endpoints.where("system = 'kafka' and module is not null").select("module").distinct().withColumn("_kafka", F.lit(True))
    c = collections.groupBy("module").agg(_names(F.lit(True), "collection").alias("databases"))
    if near is None:
        r = relations.where(F.col("relation").isin("calls_service", "publishes_to") & (F.col("source_kind") == "microservice") & (F.col("target_kind") == "microservice"))
        sides = r.select(F.explode(F.array(F.struct(F.col("source_name").alias("module"), F.col("target_name").alias("to"), F.lit(None).cast("string").alias("of")), F.struct(F.col("target_name").alias("module"), F.lit(None).cast("string").alias("to"), F.col("source_name").alias("of")))).alias("x")).select("x.*")
        near = sides.groupBy("module").agg(_names(F.lit(True), "to").alias("outgoing"), _names(F.lit(True), "of").alias("incoming"))
    out = m.join(k, "module", "left").join(c, "module", "left").join(near, "module", "left").na.fill("", ["databases", "outgoing", "incoming"])
    used = F.concat_ws(",", F.lit("Java"), F.when(F.col("starts_application"), "Spring Boot"), F.when(F.col("_kafka"), "Kafka"), F.when(F.col("databases") != "", "MongoDB"))
    return out.select("module", F.when(F.col("starts_application"), "microservice").otherwise("module").alias("kind"), "databases", used.alias("technologies"), "outgoing", "incoming")


def reply_patterns(relations: DataFrame, endpoints: DataFrame) -> DataFrame:
    """request, reply, and the producers and consumers of both (sorted, by comma) of each pair of topics that persisted relations call request and reply."""
    pairs = relations.where("relation = 'request_reply' and source_kind = 'topic' and target_kind = 'topic'").select(F.col("source_name").alias("request"), F.col("target_name").alias("reply")).distinct()
    ends = topic_summary(endpoints).select("topic", "producers", "consumers")
    side = lambda name: ends.select(F.col("topic").alias(name), F.col("producers").alias(f"{name}_producers"), F.col("consumers").alias(f"{name}_consumers"))
    return pairs.join(side("request"), "request", "left").join(side("reply"), "reply", "left").na.fill("").select("request", "reply", "request_producers", "request_consumers", "reply_producers", "reply_consumers")


def module_counts(modules: DataFrame, endpoints: DataFrame, collections: DataFrame) -> DataFrame:
    """Modules (identity, name, kind, starts_application) with collections (sorted, by comma) and how many uses of collections, of topics and of routes they serve and call they have."""
    e = endpoints.where("module is not null").groupBy(F.col("module").alias("identity"))
    n = lambda condition: F.count(F.when(condition, 1))
    counts = e.agg(n(F.col("system") == "kafka").alias("kafka_methods"), n(F.col("role") == "serve").alias("routes"), n(F.col("role") == "call").alias("calls"))
    c = collections.groupBy(F.col("module").alias("identity")).agg(_names(F.lit(True), "collection").alias("collections"), F.count("*").alias("collection_methods"))
    out = modules.select("identity", "name", "kind", "starts_application").join(counts, "identity", "left").join(c, "identity", "left")
    return out.na.fill(0, ["kafka_methods", "routes", "calls", "collection_methods"]).na.fill("", ["collections"])


def collection_details(collections: DataFrame, modules: DataFrame, classes: DataFrame) -> DataFrame:
    """collection, modules, services, operations, classes: ``collection_summary`` with the classes of ``resolution.persistence_classes``, roots first, each by name, by comma."""
    own = classes.groupBy("collection").agg(F.array_sort(F.collect_set(F.struct((~F.col("root")).alias("last"), "qualified"))).alias("_own"))
    shown = F.array_join(F.transform("_own", lambda x: x["qualified"]), ",")
    return collection_summary(collections, modules).join(own, "collection", "left").select("collection", "modules", "services", "operations", F.coalesce(shown, F.lit("")).alias("classes"))
