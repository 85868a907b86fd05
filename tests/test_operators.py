import random

from pyspark.sql import functions as F

from factloom.operators import audit, deltas, edges, filters, ranking, relations, search
from factloom.plans import catalog, traversals
from factloom.sources import manifests
from factloom.streaming import incremental

ENDPOINT = "id string, role string, system string, topic string, topic_dynamic boolean, source string, path string, start_line int, end_line int, snippet string, module string, message_type string"


def endpoint(id, role, system, topic, module, *, dynamic=False, source="code", path="A.java", line=1, end=1, snippet="", kind=None):
    return (id, role, system, topic, dynamic, source, path, line, end, snippet, module, kind)


def frame(spark, rows):
    return spark.createDataFrame(rows, ENDPOINT)


def test_kafka_edges_follow_manifests_and_skip_dynamic_topics(spark):
    e = frame(spark, [endpoint("1", "produce", "kafka", "t", "a"), endpoint("2", "produce", "kafka", "u", "a", source="manifest"), endpoint("3", "consume", "kafka", "t", "b"), endpoint("4", "consume", "kafka", "u", "b"), endpoint("5", "consume", "kafka", "u", "a", source="manifest"), endpoint("6", "produce", "kafka", "d", "c", dynamic=True), endpoint("7", "consume", "kafka", "d", "b", dynamic=True)])
    assert [tuple(r) for r in edges.kafka_edges(e).collect()] == [("a", "b", "u", 1)]


def test_rest_edges_ring_ambiguity_and_gateway(spark):
    ring = [endpoint(f"s{x}", "serve", "rest", f"GET /{x}/{{id}}", x) for x in "xyz"] + [endpoint(f"c{a}", "call", "rest", f"GET /{b}/1", a, snippet=f"http://{b}/") for a, b in ("xy", "yz", "zx")]
    got = {(r.source, r.target) for r in edges.rest_edges(frame(spark, ring)).collect()}
    assert got == {("x", "y"), ("y", "z"), ("z", "x")}
    twins = [endpoint("s1", "serve", "rest", "GET /a", "Pay"), endpoint("s2", "serve", "rest", "GET /a", "pay."), endpoint("c", "call", "rest", "GET /a", "x", snippet="http://pay/")]
    assert edges.rest_edges(frame(spark, twins)).count() == 0
    assert [r.status for r in edges.resolved_calls(frame(spark, twins)).collect()] == ["ambiguous"]
    gate = [endpoint("s1", "serve", "rest", "GET /a/b", "t"), endpoint("s2", "serve", "rest", "POST /a/c", "t"), endpoint("g", "call", "rest", "ANY /a/**", "gw", snippet="lb://t")]
    assert [r.serve_id for r in edges.rest_edges(frame(spark, gate)).collect()] == ["s1"]


def test_calls_in_consumers(spark):
    e = frame(spark, [endpoint("k", "consume", "kafka", "t", "a", line=10, end=90), endpoint("in", "call", "rest", "GET /x", "a", line=80), endpoint("out", "call", "rest", "GET /x", "a", line=91), endpoint("file", "call", "rest", "GET /x", "a", line=20, path="B.java")])
    assert [tuple(r)[:2] for r in edges.calls_in_consumers(e).distinct().collect()] == [("k", "in")]


def test_relations_last_rule_wins_and_edges_from_relations(spark):
    e = frame(spark, [endpoint("p", "produce", "kafka", "t", "a", snippet="${k} ${k} ${z}", kind="T", line=3), endpoint("c", "consume", "kafka", "t", "b", line=4), endpoint("r", "consume", "kafka", "retour_t", "b")])
    pair = spark.createDataFrame([("a", "b")], "source string, target string")
    run = spark.createDataFrame([("a",)], "module string")
    rel = relations.architecture_relations(e, pair, run, pair.limit(0), pair, replies=True)
    got = {tuple(r) for r in rel.select("source_kind", "source_name", "relation", "target_name").collect()}
    assert ("microservice", "a", "depends_on", "b") in got and ("module", "b", "consumes", "t") in got
    assert ("microservice", "a", "uses_configuration", "k") in got and ("microservice", "a", "uses_configuration", "z") in got
    assert ("topic", "t", "publishes_type", "T") in got and ("topic", "t", "request_reply", "retour_t") in got
    assert rel.count() == rel.select("id").distinct().count()
    placed = spark.createDataFrame([("publishes_to", "a", "b", "A.java", 3), ("publishes_to", "a", "b", None, None)], "relation string, source_name string, target_name string, path string, start_line int")
    assert [tuple(r) for r in edges.relations_to_edges(placed, e).collect()] == [("publishes_to", "a", "b", "p", "c")]


def test_audit_and_catalogue(spark):
    e = frame(spark, [endpoint("p", "produce", "kafka", "t", "a", kind="A"), endpoint("c", "consume", "kafka", "t", "b", kind="B"), endpoint("o", "produce", "kafka", "alone", "a"), endpoint("u", "produce", "kafka", "v", "a", kind="A"), endpoint("w", "consume", "kafka", "v", "b")])
    assert {(r.topic, r.finding) for r in audit.contracts(e).collect()} == {("t", "mismatch"), ("v", "unknown")}
    assert [tuple(r) for r in audit.orphans(e).collect()] == [("alone", "no consumer")]
    two = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "source string, target string")
    assert [tuple(r) for r in audit.rest_cycles(two).collect()] == [("a", "b")]
    summary = {r.topic: r for r in catalog.topic_summary(e).collect()}
    assert summary["t"].producers == "a" and summary["t"].consumers == "b" and summary["t"].message_types == "A,B"
    nodes, all_edges = catalog.merge_facts(spark.createDataFrame([("a",)], "id string"), two.withColumn("kind", F.lit("k")), spark.createDataFrame([("n",)], "id string"), spark.createDataFrame([("a", "b", "k"), ("n", "new", "k")], "source string, target string, kind string"))
    assert {r.id for r in nodes.collect()} == {"a", "n", "new"} and all_edges.count() == 4
    assert catalog.federate({"x": two.select(F.col("source").alias("id")), "y": two.select(F.col("source").alias("id"))}).count() == 4


def test_deltas(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {tuple(r) for r in deltas.file_delta(old, new).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")}
    f = spark.createDataFrame([(f"{k}", "ns") for k in range(5)] + [("x", "other")], "id string, namespace string")
    for given, complete, counts in ((["0", "1"], False, (0, 2, 0)), (["0", "7"], True, (1, 1, 4)), ([], True, (0, 0, 5))):
        n = spark.createDataFrame([(i, "ns") for i in given], f.schema)
        after, told = deltas.replace_namespace(f, n, "ns", complete=complete)
        assert tuple(told.first()) == counts and after.count() == 6 + counts[0] - counts[2]
    assert deltas.insert_missing(f, f).count() == 6
    r = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, path string, v string")
    fresh = spark.createDataFrame([("1", "a", "new"), ("2", "c", "moved")], r.schema)
    got = deltas.replace_for_files(r, fresh, spark.createDataFrame([("a",), ("c",)], "path string"))
    assert {(x.id, x.path, x.v) for x in got.collect()} == {("1", "a", "new"), ("2", "c", "moved")}
    deltas.save_snapshot({"facts": r}, str(tmp_path), 3)
    deltas.save_snapshot({"facts": fresh.limit(1)}, str(tmp_path), 3)
    assert deltas.load_snapshot(spark, str(tmp_path), 3)["facts"].count() == 1


def test_ranking(spark):
    s = spark.createDataFrame([(f"n{k}", k) for k in range(8)], "id string, score int")
    got = {r.id: (r.tier, r.tier_start, r.tier_end) for r in ranking.terciles(s).collect()}
    assert got["n2"] == (1, 1, 3) and got["n5"] == (2, 4, 6) and got["n7"] == (3, 7, 8)
    w = spark.createDataFrame([("r", "z", "api"), ("r", "b", "domain"), ("r", "a", "domain"), ("q", "m", "odd")], "resource string, owner string, layer string")
    assert {(r.resource, r.owner) for r in ranking.owners(w).collect()} == {("r", "a"), ("q", "m")}
    links = spark.createDataFrame([("a", "b", "http"), ("a", "b", "http"), ("a", "t", "kafka")], "source string, target string, kind string")
    assert {r.node: r.degree for r in ranking.degrees(links).collect()} == {"a": 2, "b": 1, "t": 1}


def test_search(spark):
    f = spark.createDataFrame([(1, "sql", "SQL injection", "a.py", 3, "CWE-89", "ERROR"), (2, "xss", "sql", "b.py", 1, "", "INFO"), (3, "xss", "other", "c.py", 1, "", "INFO")], "id int, rule_id string, message string, path string, start_line int, cwe string, severity string")
    hits = search.keyword_hits(f, "sql")
    assert {r.id: r.score for r in hits.collect()} == {1: 6 * 15.0 + 4 * 8.0, 2: 4 * 15.0}
    assert [r.id for r in search.search_page(hits, limit=1, offset=1).collect()] == [2]
    assert search.keyword_hits(f, "sql missing").count() == 0
    lines = search.context_lines(spark.createDataFrame([("p", "a\nb\nc")], "path string, text string"), spark.createDataFrame([(1, "p", 1)], "id int, path string, at int"), before=2, after=1)
    assert [r.shown for r in lines.orderBy("line").collect()] == ["    1| a", "    2| b"]


def test_names(spark):
    q = spark.createDataFrame([("orders",), ("ord",), ("pay",), ("none",)], "query string")
    n = spark.createDataFrame([("orders",), ("orders-x",), ("Payments",)], "name string")
    assert {r.query: r.resolved for r in filters.resolve_names(q, n).collect()} == {"orders": "orders", "ord": None, "pay": "Payments", "none": None}


def test_manifests(spark):
    md = spark.createDataFrame([("m.md", "### `svc`\n**Producer**\n| Topic | Nom physique |\n|---|---|\n| `a` | phys.a |\n| b | - |\n**Consumer**\n| c | |")], "path string, text string")
    assert {(r.module, r.role, r.topic) for r in manifests.topic_tables(md).collect()} == {("svc", "produce", "phys.a"), ("svc", "produce", "b"), ("svc", "consume", "c")}
    js = spark.createDataFrame([("g.json", '{"topics":{"a":"A"},"producers":{"m":["a","b"]},"consumers":{"n":["a"]}}'), ("bad", "{")], "path string, text string")
    assert {(r.module, r.role, r.topic) for r in manifests.flow_graphs(js).collect()} == {("m", "produce", "A"), ("m", "produce", "b"), ("n", "consume", "A")}
    pr = spark.createDataFrame([("p", "# x\na=1\nb: c=d\n!no=1\na = 2\nplain")], "path string, text string")
    assert {(r.key, r.value) for r in manifests.properties(pr).collect()} == {("a", "2"), ("b", "c=d")}
    api = spark.createDataFrame([("o", '{"paths":{"/x":{"get":{},"parameters":[]}}}')], "path string, text string")
    assert [r.route for r in manifests.openapi_routes(api).collect()] == ["GET /x"]


def graph(seed, nodes, edges_):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges_)})


def closure(pairs):
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            return reach
        reach |= more


def test_traversals_against_plain_python(spark):
    pairs = graph(5, 9, 14)
    e = spark.createDataFrame(pairs, "source string, target string")
    reach = closure(pairs)
    assert {tuple(r) for r in traversals.reachable(e).collect()} == reach
    nodes = {x for p in pairs for x in p}
    want = {n: min([n, *(m for m in nodes if (n, m) in reach and (m, n) in reach)]) for n in nodes if any(m != n and (n, m) in reach and (m, n) in reach for m in nodes)}
    assert {r.node: r.component for r in traversals.strong_components(e).collect()} == want
    line = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")], "source string, target string")
    assert [r.path for r in traversals.shortest_paths(line, "a", "e").collect()] == ["a > b > d > e", "a > c > d > e"]
    assert traversals.shortest_paths(line, "e", "a").count() == 0
    assert [r.truncated for r in traversals.shortest_paths(line, "a", "e", limit=1).collect()] == [True]
    assert {r.node: r.level for r in traversals.levels(line).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.node: r.hops for r in traversals.reachable_from(line, spark.createDataFrame([("b",)], "node string")).collect()} == {"b": 0, "d": 1, "e": 2}


def test_event_cycles_and_flows(spark):
    e = spark.createDataFrame([("a", "t"), ("t", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "source string, target string")
    kinds = spark.createDataFrame([("a", "service"), ("b", "service"), ("t", "topic"), ("x", "service"), ("y", "service")], "node string, kind string")
    assert [tuple(r) for r in traversals.event_cycles(e, kinds).collect()] == [("a", 3, 2, 1)]
    pub = spark.createDataFrame([("b", "u"), ("c", "t")], "module string, topic string")
    con = spark.createDataFrame([("b", "t"), ("c", "u"), ("d", "u")], "module string, topic string")
    assert {tuple(r) for r in traversals.flows(pub, con, "t").collect()} == {("t > b > u > c > t", "cycle", False), ("t > b > u > d", "leaf", False)}


def test_streamed_replacement(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for value in ("old", "new"):
        spark.createDataFrame([("a", value)] + [("b", "kept")] * (value == "old"), "path string, v string").coalesce(1).write.mode("append").parquet(src)
        incremental.replace_facts(spark.readStream.schema("path string, v string").parquet(src), out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.path, r.v) for r in incremental.current(spark, out).collect()} == {("a", "new"), ("b", "kept")}


def test_empty_tables(spark):
    e = frame(spark, [])
    for df in (edges.kafka_edges(e), edges.rest_edges(e), edges.calls_in_consumers(e), audit.contracts(e), catalog.topic_summary(e)):
        assert df.count() == 0
    none = spark.createDataFrame([], "source string, target string")
    assert traversals.reachable(none).count() == traversals.strong_components(none).count() == traversals.levels(none).count() == 0
