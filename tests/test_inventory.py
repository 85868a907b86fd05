import uuid
import json

import pytest
from pyspark.sql import functions as F

from factloom import scratch
from factloom.functions import text
from factloom.operators import audit, deltas, edges, filters, ranking, search
from factloom.plans import catalog
from factloom.sources import manifests
from tests.test_operators import endpoint, frame


def test_configured_clients_and_external_services(spark):
    rows = [
        endpoint("s1", "serve", "rest", "GET /a/{id}", "pay", line=5),
        endpoint("s2", "serve", "rest", "POST /b", "pay", line=2),
        endpoint("dyn", "call", "rest", "GET <dynamic>", "x", dynamic=True, snippet="domain=Pay"),
        endpoint("put", "call", "rest", "PUT <dynamic>", "y", dynamic=True, snippet="domain=pay"),
        endpoint("put2", "call", "rest", "PUT <dynamic>", "y", dynamic=True, snippet="domain=pay"),
        endpoint("own", "call", "rest", "PUT <dynamic>", "pay", dynamic=True, snippet="domain=pay"),
        endpoint("none", "call", "rest", "PUT <dynamic>", "y", dynamic=True, snippet="domain=absent"),
        endpoint("plain", "call", "rest", "GET <dynamic>", "z", dynamic=True, snippet="http://pay/"),
        endpoint("e1", "call", "rest", "GET /q", "x", snippet="external=Partner http://pay/"),
        endpoint("e2", "call", "rest", "GET /q", "x", snippet="external=partner"),
        endpoint("deep", "call", "rest", "GET /a/1 <dynamic>", "z", dynamic=True, snippet="lb://PAY"),
    ]
    e = frame(spark, rows)
    rest = edges.rest_edges(e)
    assert {(r.call_id, r.serve_id, r.call) for r in rest.collect()} == {("dyn", "s1", "GET /a/{id}"), ("deep", "s1", "GET /a/1 <dynamic>")}
    assert {tuple(r) for r in edges.configured_edges(e, rest).collect()} == {("put", "y", "pay")}
    assert {tuple(r) for r in edges.external_edges(e).collect()} == {("e1", "x", "partner")}
    kinds = {(r.kind, r.source, r.target) for r in edges.service_graph(e).collect()}
    assert kinds == {("rest", "x", "pay"), ("rest", "z", "pay"), ("configured", "y", "pay"), ("external", "x", "partner")}
    known = spark.createDataFrame([("pay", "Money."), ("gone", "money")], "service string, alias string")
    more = frame(spark, [*rows, endpoint("al", "call", "rest", "GET /a/7", "x", snippet="https://money/")])
    assert "al" in {r.call_id for r in edges.rest_edges(more, known).collect()}
    hint = spark.range(1).select(text.target_hint(F.lit("c.getPaymentInfoServiceUrl() http://h/"), getters=True).alias("a"), text.target_hint(F.lit("c.getPaymentInfoServiceUrl() http://h/")).alias("b")).first()
    assert tuple(hint) == ("payment-info-service", "h")


def test_gateways_keep_the_first_route_by_place(spark):
    e = frame(spark, [endpoint("a", "serve", "rest", "GET /z", "t", line=9), endpoint("b", "serve", "rest", "GET /a/b", "t", line=3), endpoint("c", "serve", "rest", "GET /a/c", "t", line=7), endpoint("g", "call", "rest", "ANY /a/**", "gw", snippet="lb://t"), endpoint("w", "serve", "rest", "GET /**", "t", line=1), endpoint("n", "call", "rest", "GET /a/b", "x", snippet="lb://t")])
    assert {(r.call_id, r.serve_id) for r in edges.rest_edges(e).collect()} == {("g", "w"), ("n", "b"), ("n", "w")}


def test_audit_of_endpoints_modules_and_order(spark):
    e = frame(spark, [endpoint("p", "produce", "kafka", "t", "a"), endpoint("c", "consume", "kafka", "t", "a", line=2), endpoint("q", "produce", "kafka", "u", "a", line=3), endpoint("r", "consume", "kafka", "u", "b", line=4), endpoint("h", "call", "rest", "GET <dynamic>", "b", dynamic=True), endpoint("i", "serve", "rest", "GET /x", "b", dynamic=True), endpoint("k", "call", "rest", "GET /y", "b", dynamic=True)])
    kafka = edges.kafka_edges(e)
    assert {r.id for r in audit.orphan_endpoints(e, kafka).collect()} == {"p", "c"}
    assert {tuple(r) for r in audit.orphan_integrations(e).collect()} == {("api", "GET <dynamic>", "no provider"), ("api", "GET /x", "no consumer"), ("api", "GET /y", "no provider")}
    modules = spark.createDataFrame([("a", "library", False), ("b", "application", True), ("z", "aggregator", False), ("y", "library", False)], "identity string, kind string, starts_application boolean")
    used = spark.createDataFrame([("y", "col", "save"), ("y", "col", "findAll"), ("z", "col", "save")], "module string, collection string, operation string")
    idle = audit.idle_module_activity(modules, e, used)
    assert {tuple(r) for r in idle.collect()} == {("a", 0, 2, 1, 0, 0), ("y", 0, 0, 0, 1, 1)}
    cycles = spark.createDataFrame([("a", "a b", "a > t > b")], "component string, services string, path string")
    rows = audit.in_order(audit.audit(e, edges.rest_edges(e), edges.calls_in_consumers(e), kafka=kafka, idle=idle, cycles=cycles)).collect()
    assert [r.rule for r in rows if r.rule == "dynamic-http-target"] == ["dynamic-http-target"]
    assert {r.rule for r in rows} == {"dynamic-http-target", "orphan-kafka-producer", "orphan-kafka-consumer", "non-runtime-module-activity", "event-dependency-cycle"}
    assert [(r.severity, r.rule, r.evidence) for r in rows] == sorted((r.severity, r.rule, r.evidence) for r in rows)
    assert {r.confidence for r in rows if r.rule.startswith("event")} == {"medium"}


def test_names_by_contained_text(spark):
    names = ["Alpha", "alphabet", "Beta", "a", "", None, "Gamma.x", "ta"]
    asked = ["alpha", "Alpha", "bet", "gam", "t", "ta", "", "zz", None, "a.x", "aaaa"]

    def plain(q):
        if q is None:
            return None
        known = {n for n in names if n is not None}
        if q in known:
            return q
        hits = [n for n in known if q.lower() in n.lower()]
        return hits[0] if len(hits) == 1 else None

    n, q = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in asked], "query string")
    assert {(r.query, r.resolved) for r in filters.resolve_names(q, n).collect()} == {(x, plain(x)) for x in asked}
    assert "NestedLoop" not in filters.resolve_names(q.where("length(query) > 2"), n)._jdf.queryExecution().executedPlan().toString()


def test_terciles_over_ranges(spark):
    rows = [(f"n{k:03}", k % 5) for k in range(101)]
    got = {r.id: r for r in ranking.terciles(spark.createDataFrame(rows, "id string, score int").repartition(7)).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    sizes = [34, 34, 33]
    starts = [1, 35, 69]
    for k, (name, _) in enumerate(order):
        tier = 0 if k < 34 else 1 if k < 68 else 2
        r = got[name]
        assert (r["rank"], r.population, r.tier, r.tier_start, r.tier_end) == (k + 1, 101, tier + 1, starts[tier], starts[tier] + sizes[tier] - 1)
    assert ranking.terciles(spark.createDataFrame([], "id string, score int")).count() == 0
    one = ranking.terciles(spark.createDataFrame([("a", 1)], "id string, score int")).first()
    assert (one.tier, one.tier_start, one.tier_end) == (1, 1, 1)


def test_layers(spark):
    rows = [("x-repository", True, "core", "persistence"), ("domain-x", True, None, "domain"), ("x", True, "PORTAIL", "api"), ("x", True, "cycle-de-vie", "orchestration"), ("contract-x", False, "", "api"), ("x-infra", False, "", "infrastructure"), ("lib-x", False, "", "shared"), ("x", True, "", "application"), ("x", False, "", "module")]
    df = spark.createDataFrame(rows, "name string, runs boolean, space string, want string")
    assert df.where(ranking.layer(F.col("name"), F.col("runs"), F.col("space"), conventions=True) != F.col("want")).count() == 0


def test_blank_search_is_the_inventory(spark):
    f = spark.createDataFrame([(1, "sql", "m", "b.py", 3, "INFO"), (2, "sql", "m", "a.py", 1, "ERROR"), (3, "xss", "m", "c.py", 1, "WARNING")], "id int, rule_id string, message string, path string, start_line int, severity string")
    assert [(r.id, r.score) for r in search.search_findings(f, "  ", limit=5).collect()] == [(2, 0.0), (3, 0.0), (1, 0.0)]
    assert [r.id for r in search.search_findings(f, "", limit=1, offset=1, rule="sql").collect()] == [1]
    assert [r.id for r in search.search_findings(f, "xss", limit=5, least="WARNING").collect()] == [3]


def test_fact_manifests(spark):
    good = {"mode": "complete", "generated_by": {"namespace": "n"}, "nodes": [{"id": "a", "kind": "api", "name": "A", "evidence": [{"path": "x.py", "start_line": 0}]}, {"id": "b", "kind": "topic", "name": "B", "status": "ambiguous", "reason": "two"}], "edges": [{"id": "e", "kind": "calls", "source": "a", "target": "b", "relation": " "}]}
    bad = {"nodes": [{"id": "a", "kind": "api", "name": " "}, {"id": "a", "kind": "sun", "name": "B"}, {"id": None, "kind": "api", "name": "C", "status": "unresolved"}], "edges": [{"id": "e", "kind": "calls", "source": "a", "target": "zz", "confidence": "sure"}, {"id": "f", "kind": "", "source": "a"}]}
    files = spark.createDataFrame([("g", json.dumps(good)), ("b", json.dumps(bad)), ("j", "no json"), ("n", None)], "path string, text string")
    items = manifests.fact_items(files)
    problems = {(r.path, r.fact_type, r.n, r.problem) for r in manifests.fact_violations(items).collect()}
    assert problems == {("b", "node", 0, "no name"), ("b", "node", 0, "repeated id"), ("b", "node", 1, "repeated id"), ("b", "node", 1, "unknown kind"), ("b", "node", 2, "no id"), ("b", "node", 2, "no reason"), ("b", "edge", 0, "unknown end"), ("b", "edge", 0, "status or confidence"), ("b", "edge", 1, "no kind"), ("b", "edge", 1, "no end")}
    facts = {r.id: r for r in manifests.manifest_facts(items).collect()}
    assert set(facts) == {"n::node::a", "n::node::b", "n::edge::e"}
    assert facts["n::node::a"].evidence_line is None and facts["n::node::b"].note == "two" and facts["n::edge::e"].complete
    assert (facts["n::edge::e"].source_name, facts["n::edge::e"].target_kind, facts["n::edge::e"].relation) == ("A", "topic", "calls")
    services = spark.createDataFrame([("A",), ("Z",)], "service string")
    assert {tuple(r) for r in manifests.fact_services(manifests.manifest_facts(items), services).collect()} == {("n::node::a", "A"), ("n::edge::e", "A")}


def test_files_roots_owners_and_properties(spark):
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    assert {r.folder for r in manifests.nested_roots(paths("a/pom.xml", "a/b/pom.xml", "c/d/pom.xml", "1/2/3/4/5/6/pom.xml")).collect()} == {"a", "c/d"}
    assert manifests.nested_roots(paths("pom.xml", "a/pom.xml")).count() == 0
    kept = manifests.without_excluded(paths("a/core/x", "a/order-Test/x", "a/mocks/y/z"), paths("a/core", "a/order-Test", "a/mocks"))
    assert [r.path for r in kept.collect()] == ["a/core/x"]
    named = spark.createDataFrame([("a/b/api.yml", "built")], "path string, module string")
    around = spark.createDataFrame([("a", "A"), ("a/b", "B")], "folder string, module string")
    assert {tuple(r) for r in manifests.contract_owners(paths("a/b/api.yml", "a/b/c/d.yml", "a/x.yml", "q.yml"), named, around).collect()} == {("a/b/api.yml", "built"), ("a/b/c/d.yml", "B"), ("a/x.yml", "A"), ("q.yml", None)}
    files = paths("application.yml", "m/application.properties", "m/application-prod.yml", "m/application-dev.yml", "m/other.yml")
    spots = spark.createDataFrame([("m/src/A.java",)], "spot string")
    ranked = manifests.property_rank(files, spots, ["prod"]).orderBy("rank").collect()
    assert [r.path for r in ranked] == ["m/application.properties", "m/application-prod.yml", "application.yml"]
    yml = "a:\n  b: 1\n  'c': \"x y\" # no\n  list:\n    - k: v\n    - w\n  d:\n    e: true\ntop: |\n  text: here\nurl: http://h:80/x\nempty:\n"
    flat = {r.key: r.value for r in manifests.flattened(spark.createDataFrame([("f", yml), ("g", None), ("h", "")], "path string, text string")).collect()}
    assert flat == {"a.b": "1", "a.c": "x y", "a.d.e": "true", "top": "text: here\n", "url": "http://h:80/x"}
    texts = spark.createDataFrame([("f", "one\ntwo\nthree")], "path string, text string")
    spots = spark.createDataFrame([(1, "f", 2, 9), (2, "f", 0, None), (3, "f", 7, 8)], "id int, path string, start_line int, end_line int")
    assert {tuple(r) for r in manifests.snippets(texts, spots).collect()} == {(1, "two\nthree"), (2, None), (3, None)}


def test_mutations(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, path string")
    assert deltas.insert_unique(old, spark.createDataFrame([(3, "c")], old.schema)).count() == 3
    with pytest.raises(Exception, match="repeated key 2"):
        deltas.insert_unique(old, spark.createDataFrame([(2, "c")], old.schema)).collect()
    assert [r.id for r in deltas.delete_keys(old, old.where("id = 1")).collect()] == [2]
    assert [r.id for r in deltas.remove_files({"t": old}, old.where("id = 2"))["t"].collect()] == [1]
    meta = spark.createDataFrame([("k", "v")], "key string, value string")
    rows, meta = deltas.purge_once(old, meta, "purged")
    assert rows.count() == 0 and {tuple(r) for r in meta.collect()} == {("k", "v"), ("purged", "done")}
    assert deltas.purge_once(old, meta, "purged")[0].count() == 2
    assert deltas.stale(meta, "x") and not deltas.stale(deltas.upsert(meta, spark.createDataFrame([("signature", "x")], meta.schema), "key"), "x")
    assert [r.line for r in deltas.as_json(spark.createDataFrame([(2, None), (1, "é")], "id int, path string"), ["id"]).collect()] == ['{"id":1,"path":"é"}', '{"id":2,"path":null}']
    assert [tuple(r) for r in deltas.migrated(old, {"id": "string", "kind": "string", "n": "int"}, {"kind": "x"}).orderBy("id").collect()] == [("1", "x", None), ("2", "x", None)]
    deltas.save_snapshot({"facts": old}, str(tmp_path / "a"), 1)
    deltas.save_snapshot({"facts": old}, str(tmp_path / "b"), 9)
    both, warnings = deltas.load_inventories(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "c": str(tmp_path / "none")}, 1, "facts")
    assert {(r.id, r.service) for r in both.collect()} == {(1, "a"), (2, "a")} and set(warnings) == {"b", "c"}


def test_listing_and_federation(spark):
    e = frame(spark, [endpoint("1", "produce", "kafka", "t", "a", kind="D"), endpoint("2", "call", "rest", "GET /x", None), endpoint("3", "consume", "kafka", "t", "b")])
    modules = spark.createDataFrame([("a", "A", "application", True), ("b", "B", "library", False), ("c", "B", "aggregator", False)], "identity string, name string, kind string, starts_application boolean")
    used = spark.createDataFrame([("a", "col", "save"), ("b", "col", "find")], "module string, collection string, operation string")
    names = lambda kind: {r.name for r in catalog.list_objects(kind, e, modules, used).collect()}
    assert (names("Services"), names("topics"), names("api"), names("dto"), names("endpoint"), names("collection"), names("odd")) == ({"a"}, {"t"}, {"GET /x"}, {"D"}, {"1", "2", "3"}, {"col"}, set())
    assert [tuple(r) for r in catalog.collection_summary(used, modules).collect()] == [("col", "a,b", "a", 2)]
    asked = spark.createDataFrame([("a",), ("A",), ("B",), ("q",)], "reference string")
    assert {tuple(r) for r in catalog.module_by_reference(asked, modules).collect()} == {("a", "a"), ("A", "a"), ("B", None), ("q", None)}
    assert {(r.module, r.n) for r in catalog.endpoints_by_module(e, keep_null=True).collect()} == {("a", 1), ("b", 1), (None, 1)}
    assert {r.service for r in catalog.deployable(e, modules).collect()} == {"a"}
    rel = spark.createDataFrame([("r", "s1", "microservice", "me", "topic", "me"), ("r", "s1", "module", "me", "microservice", "me"), ("q", "s2", "module", "x", "topic", "y")], "id string, service string, source_kind string, source_name string, target_kind string, target_name string")
    local = spark.createDataFrame([("s1", "me")], "service string, local string")
    got = {r.id: (r.source_name, r.target_name) for r in catalog.federated(rel, local).collect()}
    assert got == {"s1:r": ("s1", "me"), "s2:q": ("x", "y")}
    work = catalog.workspace_services(modules)
    assert {tuple(r) for r in work.collect()} == {("a", "microservice"), ("b", "shared-module")}
    assert [r.service for r in catalog.federation_warnings(work, local).collect()] == ["a"]
    assert catalog.graph_totals(spark.createDataFrame([], "source string, target string, kind string, confidence string")).where("n > 0").count() == 0


def test_indexes_are_written_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert scratch.index(spark, "some", "name", make).count() == scratch.index(spark, "some", "name", make).count() == 3
    assert len(made) == 1
    grown = scratch.Grown(spark.range(2))
    grown.add(spark.range(5, 7))
    assert sorted(r.id for r in grown.all().collect()) == [0, 1, 5, 6]


def test_files_are_scanned_with_digests(spark, tmp_path):
    import hashlib

    for path, body in {"a/x.py": "one", "src/test/y.py": "no", ".git/z": "no", "b/x.txt": "two"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    got = {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[-1]: r.sha256 for r in manifests.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": hashlib.sha256(b"one").hexdigest(), "b/x.txt": hashlib.sha256(b"two").hexdigest()}
    assert [r.path.rsplit("/", 1)[-1] for r in manifests.scan_files(spark, str(tmp_path), include=["*.py"]).collect()] == ["x.py"]


def test_properties_missing_services_and_ids(spark):
    import hashlib

    from factloom.functions import ids
    from factloom.operators import resolution

    wanted = spark.createDataFrame([("1", "k", "d"), ("2", "z", "d"), ("3", None, "d"), ("4", "z", None)], "id string, key string, default string")
    found = spark.createDataFrame([(2, "k", "late"), (1, "k", "first")], "rank int, key string, value string")
    assert {tuple(r) for r in manifests.resolve_property(wanted, found).collect()} == {("1", "first"), ("2", "d"), ("3", "d"), ("4", None)}
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "service string")
    assert [r.service for r in resolution.missing_services(names("a", "b", "b"), names("a")).collect()] == ["b"]
    own = spark.range(1).select(ids.fact_id(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("x")).first().x
    assert own == hashlib.sha256(b"a||b").hexdigest()


def test_streams_of_endpoints(spark, tmp_path):
    from factloom.streaming import incremental

    rows = [("1", "a", "2024-01-01 00:01:00"), ("1", "a", "2024-01-01 00:02:00"), ("2", "b", "2024-01-01 00:12:00")]
    df = spark.createDataFrame(rows, "id string, module string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.latest_endpoints(stream()).writeStream.format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("latest").collect()) == ["1", "2"]
    q = incremental.activity(stream()).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.module, r.n) for r in spark.table("activity").collect()) == [("a", 2), ("b", 1)]


def test_deleted_files_leave(spark, tmp_path):
    from factloom.streaming import incremental

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, v string, deleted boolean"
    for rows in ([("a", "old", False), ("b", "kept", None)], [("a", None, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.replace_facts(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.path, r.v) for r in incremental.current(spark, out).collect()} == {("b", "kept")}


def test_equal_yaml_texts_are_read_once_a_task(spark, tmp_path):
    from factloom.sources import manifests

    folder = str(tmp_path)

    def counted(text):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return [{"a": text}]

    known = manifests._documents
    manifests._documents = counted
    try:
        files = spark.createDataFrame([(f"{k}.yml", f"t{k % 3}") for k in range(30)] + [("none.yml", None)], "path string, text string").coalesce(1)
        got = dict(tuple(r) for r in manifests.yaml_as_json(files).collect())
    finally:
        manifests._documents = known
    assert got["4.yml"] == '{"a": "t1"}' and len(got) == 31 and len(list(tmp_path.iterdir())) == 4


def test_totals_read_the_graph_once(spark):
    graph = spark.createDataFrame([("a", "b", "http", "high"), ("b", "c", "http", "medium"), ("c", None, "uses", "high")], "source string, target string, kind string, confidence string")
    out = catalog.graph_totals(graph)
    assert {tuple(r) for r in out.collect()} == {("nodes", 4), ("links", 3), ("kind http", 2), ("kind uses", 1), ("confidence high", 2), ("confidence medium", 1)}
    assert {tuple(r) for r in catalog.graph_totals(graph.limit(0)).collect()} == {("nodes", 0), ("links", 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("source#") and out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_few_routes_are_sent_to_the_calls(spark):
    row = lambda i, role, topic, module, snippet="": (i, role, "rest", topic, False, "code", f"{i}.java", 1, 1, snippet, module, None)
    schema = "id string, role string, system string, topic string, topic_dynamic boolean, source string, path string, start_line int, end_line int, snippet string, module string, message_type string"
    e = spark.createDataFrame([row("c", "call", "GET /x/1", "a", "get(http://b/x)"), row("g", "call", "ANY /x/**", "a", "lb://b"), row("s", "serve", "GET /x/{id}", "b"), row("t", "serve", "POST /x/{id}", "b"), row("u", "serve", "GET /x/1", "lone")], schema)
    rest = edges.rest_edges(e)
    assert {(r.call_id, r.serve_id) for r in rest.collect()} == {("c", "s"), ("g", "s")}
    assert "ResolvedHint (strategy=broadcast)" in rest._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in rest._jdf.queryExecution().optimizedPlan().toString()
    assert edges.sent_if_small(e, 4)._jdf.queryExecution().analyzed().toString().count("broadcast") == 0


def test_relations_are_sent_without_a_sort_and_by_what_is_asked(spark):
    from factloom.operators import relations

    e = spark.createDataFrame([("produce", "kafka", "t", False, "code", "p", 1, "", "m", "x"), ("produce", "kafka", "retour_t", False, "code", "p", 2, "", "m", None)], "role string, system string, topic string, topic_dynamic boolean, source string, path string, start_line int, snippet string, module string, message_type string")
    nothing, run = spark.createDataFrame([], "source string, target string"), spark.createDataFrame([("m",)], "module string")
    whole = relations.architecture_relations(e, nothing, run, nothing, nothing, replies=True)
    some = relations.architecture_relations(e, nothing, run, nothing, nothing, replies=True, only=["request_reply"])
    assert some.collect() == whole.where("relation = 'request_reply'").collect() and some.count() == 1 and whole.count() == 4
    assert whole._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
