"""Names, evidence, merged graphs, owners, orders and projected manifests on small fixtures."""

import json

from pyspark.sql import functions as F

from factloom.operators import audit, ranking
from factloom.plans import catalog
from factloom.sources import manifests

ENDPOINT = "id string, role string, system string, topic string, topic_dynamic boolean, source string, module string, message_type string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_evidence_by_all_five_precedences(spark):
    e = [(f"{k}", "produce", "kafka", f"t{k}", k == 2, source, "m", None) for k, source in enumerate(["manifest", "openapi", "code", "manifest", "code"])]
    e += [("x", "produce", "kafka", "t3", True, "code", "m", None), ("y", "produce", "kafka", "t1", True, "manifest", "m", None), ("z", "produce", "kafka", "t4", False, "openapi", "m", None)]
    got = catalog.service_links(spark.createDataFrame(e, ENDPOINT), conventions=F.col("id") == "4")
    assert {r.target: r.evidence for r in got.collect()} == {"t0": "manifest", "t1": "openapi", "t2": "dynamic", "t3": "dynamic", "t4": "strategy1"}


def test_merged_nodes_and_conflicts_on_each_side(spark):
    nodes = spark.createDataFrame([("microservice", "a", "A", "java", "domain", "confirmed"), ("topic", "t", "T", None, None, "confirmed"), ("microservice", "b", "B", "go", None, "confirmed")], "kind string, name string, label string, technology string, layer string, status string")
    told = [("service", "a", "n2", "kotlin", None, "ambiguous", 1), ("microservice", "a", "n1", "", "api", "confirmed", 2), ("service", "a", "n1", "rust", None, "ambiguous", 3), ("topic", "t", "n1", "kafka", None, "confirmed", 4), ("service", "new", "n9", None, None, "inferred", 5), ("service", "new", "n8", None, "domain", "confirmed", 6), ("topic", None, "n", None, None, None, 7)]
    known = spark.createDataFrame(told, "kind string, name string, namespace string, technology string, layer string, status string, at int")
    merged, conflicts = catalog.merged_nodes(nodes, known)
    assert rows(merged) == {
        ("microservice:a", "microservice", "a", "A", "rust", "api", "confirmed", "n1,n2"),
        ("topic:t", "topic", "t", "T", "kafka", None, "confirmed", ""),
        ("microservice:b", "microservice", "b", "B", "go", None, "confirmed", ""),
        ("microservice:new", "microservice", "new", "new", None, "domain", "inferred", "n8,n9"),
    }
    assert rows(conflicts) == {("microservice:a", "technology", "rust", "java"), ("microservice:a", "layer", "api", "domain"), ("microservice:a", "status", "confirmed", "ambiguous")}


def test_cycles_name_their_first_members_only(spark):
    pairs = [(f"s{k:02}", f"t{k:02}") for k in range(30)] + [(f"t{k:02}", f"s{(k + 1) % 30:02}") for k in range(30)] + [("a", "q"), ("q", "b"), ("b", "a"), ("x", "y"), ("y", "x")]
    kinds = spark.createDataFrame([(n, "topic" if n[0] in "tq" else "service") for n in sorted({x for p in pairs for x in p})], "node string, kind string")
    got = {r.component: r for r in audit.event_cycle_rows(spark.createDataFrame(pairs, "source string, target string"), kinds).collect()}
    assert set(got) == {"s00", "a"} and got["a"].path == "a -> b -> q" and got["a"].services == "a b"
    assert got["s00"].services == " ".join(f"s{k:02}" for k in range(20)) + " and 10 more"
    assert got["s00"].path == " -> ".join(f"s{k:02}" for k in range(20)) + " -> and 40 more"


def test_layers_are_conventional_on_request_only(spark):
    m = spark.createDataFrame([("shop-api", True, None), ("domain-x", False, "core"), ("plain", True, "PORTAIL"), ("x-data", False, "Cycle-de-vie"), ("lib-x", False, ""), ("plain", False, None)], "name string, runs boolean, space string")
    of = lambda **k: [r[0] for r in m.select(ranking.layer(F.col("name"), F.col("runs"), F.col("space"), **k)).collect()]
    assert of() == ["application", "module", "application", "module", "module", "module"]
    assert of(conventions=True) == ["api", "domain", "api", "orchestration", "shared", "module"]


def test_owners_are_microservices_that_publish_or_write(spark):
    w = [("microservice", "b", "publishes", "topic", "t"), ("service", "a", "publishes", "topic", "t"), ("module", "z", "publishes", "topic", "t"), ("microservice", "c", "consumes", "topic", "u"), ("microservice", "b", "writes", "collection", "k"), ("microservice", "d", "writes", "collection", "k"), ("microservice", "e", "reads", "collection", "r")]
    services = spark.createDataFrame([("a", "application"), ("b", "application"), ("d", "domain")], "name string, layer string")
    got = ranking.resource_owners(spark.createDataFrame(w, "source_kind string, source_name string, relation string, target_kind string, target_name string"), services)
    assert rows(got) == {("kafka_topic", "t", "a", "application"), ("mongodb_collection", "k", "d", "domain")}


def test_neighbours_of_types_endpoints_and_collections(spark):
    e = spark.createDataFrame([("1", "produce", "kafka", "t", False, "code", "m", "T"), ("2", "consume", "kafka", "t", False, "code", None, "T"), ("3", "serve", "rest", "GET /x", False, "code", "m", "ignored")], ENDPOINT)
    got = rows(catalog.object_neighbours(e, spark.createDataFrame([("m", "n")], "source string, target string"), spark.createDataFrame([("m", "c"), ("m", "c")], "module string, collection string")))
    assert {r for r in got if r[0] in ("dto", "endpoint", "collection")} == {
        ("dto", "T", "published_as", "topic", "t"), ("dto", "T", "consumed_as", "topic", "t"), ("dto", "T", "producer", "module", "m"), ("endpoint", "1", "belongs_to", "module", "m"), ("endpoint", "1", "implements", "topic", "t"),
        ("endpoint", "2", "implements", "topic", "t"), ("endpoint", "3", "belongs_to", "module", "m"), ("endpoint", "3", "implements", "api", "GET /x"), ("collection", "c", "uses", "module", "m"),
    }
    assert ("module", "m", "uses", "collection", "c") in got and ("module", "n", "used_by", "module", "m") in got


def test_stated_orders(spark):
    issues = spark.createDataFrame([("info", "a", "1"), ("warning", "b", "2"), ("warning", "b", "1"), ("error", "a", "0")], "severity string, code string, message string")
    assert [tuple(r) for r in catalog.issues_in_order(issues).collect()] == [("warning", "b", "1"), ("warning", "b", "2"), ("error", "a", "0"), ("info", "a", "1")]
    nodes = spark.createDataFrame([("topic", "s", "a"), ("topic", None, "z"), ("api", "x", "q")], "kind string, service string, name string")
    assert [r.name for r in catalog.nodes_in_order(nodes).collect()] == ["q", "z", "a"]


def test_yaml_as_a_parser_reads_it(spark):
    yml = "a: 'x # y'\nb: {c: 1, d: [2], \"e\": \"f: g\"} # remark\nl:\n  - k: v\ntext: |\n  one\n  two\n---\na: last\nnone:\nempty: ''\n"
    files = spark.createDataFrame([("f", yml), ("g", None), ("h", "a: [unclosed"), ("i", '{"j": {"k": true}}')], "path string, text string")
    assert rows(manifests.flattened(files)) == {("f", "a", "last"), ("f", "b.c", "1"), ("f", "b.e", "f: g"), ("f", "text", "one\ntwo\n"), ("i", "j.k", "true")}
    api = spark.createDataFrame([("x.YML", "paths:\n  /a/{id}: {get: {}, parameters: []}\n  /b:\n    post: 1"), ("y.json", '{"paths": {"/c": {"put": {}}}}'), ("z.yaml", "- 1"), ("w.yml", ": :")], "path string, text string")
    assert rows(manifests.openapi_routes(api)) == {("x.YML", "GET /a/{id}"), ("x.YML", "POST /b"), ("y.json", "PUT /c")}


def test_projected_manifests(spark):
    node = lambda i, kind: {"id": i, "kind": kind, "name": f"N{i}"}
    edge = lambda i, kind, a, b, **more: {"id": i, "kind": kind, "source": a, "target": b, "relation": f"r{i}", "confidence": "high", "evidence": [{"path": "p", "start_line": 4}], **more}
    good = {"generated_by": {"namespace": "ns"}, "nodes": [node("a", "microservice"), node("b", "external"), node("c", "collection")], "edges": [edge("1", "http", "a", "b"), edge("2", "kafka", "b", "a"), edge("3", "data", "a", "c"), edge("4", "http", "a", "c"), edge("5", "kafka", "a", "b", status="unresolved", reason="why")]}
    bad = {"generated_by": {"namespace": "bad"}, "nodes": [node("a", "microservice")], "edges": [edge("1", "http", "a", "nowhere")]}
    files = spark.createDataFrame([("g", json.dumps(good)), ("b", json.dumps(bad))], "path string, text string")
    endpoints, edges, issues = manifests.projected_facts(manifests.fact_items(files))
    assert {(r.id, r.role, r.system, r.topic, r.module, r.start_line) for r in endpoints.collect()} == {
        ("ns::edge::1#source", "call", "rest", "r1", "Na", 4), ("ns::edge::1#target", "serve", "rest", "r1", "Nb", 4), ("ns::edge::2#source", "produce", "kafka", "r2", "Nb", 4), ("ns::edge::2#target", "consume", "kafka", "r2", "Na", 4),
    }
    assert {tuple(r)[:3] for r in edges.collect()} == {("rest", "Na", "Nb"), ("kafka", "Nb", "Na")}
    assert rows(issues) == {("ns::edge::5", "why")}


def test_complexity_details(spark):
    links = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("a", "a", "z"), ("t", "b", "x")], "source string, target string, kind string")
    found = spark.createDataFrame([("a", "INFO"), ("a", "ERROR"), ("a", "INFO"), ("q", "ERROR")], "service string, severity string")
    got = catalog.complexity_details(links, spark.createDataFrame([("a",), ("b",), ("c",)], "service string"), found)
    assert rows(got) == {("a", 4, 3, "ERROR=1, INFO=2"), ("b", 3, 0, "none"), ("c", 0, 0, "none")}
