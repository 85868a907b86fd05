"""Maintained tables, versions, and notice of changed sources."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from factloom import scratch
from factloom.operators import edges, maintenance
from factloom.sources import commits, facts

COLUMNS = "id string, role string, system string, topic string, topic_dynamic boolean, source string, path string, start_line int, end_line int, snippet string, module string, message_type string"


def drawn(rng, files):
    rows = []
    for f in files:
        for line in range(rng.randrange(1, 5)):
            system = rng.choice(["kafka", "rest"])
            role = rng.choice(["produce", "consume"] if system == "kafka" else ["serve", "call"])
            module = f"svc-{rng.randrange(7)}"
            topic = f"t{rng.randrange(5)}" if system == "kafka" else f"{rng.choice(['GET', 'ANY'])} /a{rng.randrange(3)}/{rng.choice(['{id}', 'x', 'y'])}"
            snippet = rng.choice([f"get(http://svc-{rng.randrange(9)}/x)", f"lb://solo-{rng.randrange(7)}", f"domain=svc-{rng.randrange(9)}", "client.call("]) if role == "call" else ""
            rows.append((f"{f}:{line}", role, system, topic, system == "kafka" and rng.random() < 0.1, "manifest" if rng.random() < 0.08 else "code", f, line * 10, line * 10 + 5, snippet, module, None))
    return rows


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_a_refresh_equals_a_rebuild(spark):
    rng = random.Random(1)
    aliases = spark.createDataFrame([(f"svc-{k}", f"solo-{k // 2}") for k in range(9)], "service string, alias string")
    for turn in range(4):
        files = [f"f{k}" for k in range(30)]
        before = drawn(rng, files)
        hit = set(rng.sample(files, 3)) | ({"new"} if turn % 2 else set())
        fresh = drawn(rng, sorted(hit - {min(hit)}))  # one file has gone
        make = lambda r: spark.createDataFrame(r, COLUMNS)
        whole = make([r for r in before if r[6] not in hit] + fresh)
        old = make(before)
        tables = {"endpoints": old, "kafka": edges.kafka_edges(old), "rest": edges.rest_edges(old, aliases)}
        changed = spark.createDataFrame([(p,) for p in sorted(hit)], "path string")
        got = maintenance.refreshed(tables, make(fresh), changed, aliases)
        assert rows(got["endpoints"]) == rows(whole)
        assert rows(got["kafka"]) == rows(edges.kafka_edges(whole))
        assert rows(got["rest"]) == rows(edges.rest_edges(whole, aliases))


def test_untouched_edges_are_kept_and_not_derived(spark):
    """Edges that a change doesn't touch are those of the old table: marked ones keep their mark."""
    rng = random.Random(2)
    old = spark.createDataFrame(drawn(rng, [f"f{k}" for k in range(40)]), COLUMNS)
    kafka = edges.kafka_edges(old).withColumn("links", F.lit(-1).cast("long"))
    changed = spark.createDataFrame([("f1",)], "path string")
    touched = maintenance.touched_modules(old, old.limit(0), changed)
    topics = {r.topic for r in old.join(touched, "module", "left_semi").collect()}
    got = maintenance.refreshed_kafka_edges(kafka, old, old.where("path <> 'f1'"), touched).collect()
    assert all((r.links == -1) == (r.topic not in topics) for r in got)


def test_the_index_notices_changed_sources(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/lineitem.parquet")
    read = lambda: scratch.index(spark, folder, "some", lambda: spark.read.parquet(f"{folder}/lineitem.parquet"), ["lineitem"]).count()
    assert read() == 3
    first = scratch.INDEXES[(spark.sparkContext.applicationId, folder, "some")]
    assert read() == 3 and scratch.INDEXES[(spark.sparkContext.applicationId, folder, "some")] == first
    spark.range(5).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert read() == 8


def test_the_second_writer_is_refused(spark, tmp_path):
    store = commits.Versions(spark, str(tmp_path / "v"))
    assert store.latest() == 0
    store.commit({"a": spark.range(3), "b": spark.range(1)}, 0)
    one, two = commits.Versions(spark, store.path), commits.Versions(spark, store.path)
    parent = one.latest()
    assert one.commit({"a": spark.range(5)}, parent) == 2
    with pytest.raises(commits.Conflict):
        two.commit({"a": spark.range(9)}, parent)
    assert store.read("a").count() == 5 and store.read("b").count() == 1 and store.read("a", 1).count() == 3
    assert store.recover(0) == []  # the refused writer's folder has gone


def test_writers_at_once_all_come_through(spark, tmp_path):
    store = commits.Versions(spark, str(tmp_path / "v"))
    store.commit({"a": spark.range(0)}, 0)
    failed = []

    def add(k):
        try:
            commits.Versions(spark, store.path).update(lambda s, v: {"a": s.read("a", v).union(spark.range(k, k + 1))}, tries=12)
        except Exception as problem:
            failed.append(problem)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(r.id for r in store.read("a").collect()) == [0, 1, 2, 3] and store.latest() == 5


def test_a_writer_that_fails_leaves_nothing(spark, tmp_path):
    store = commits.Versions(spark, str(tmp_path / "v"))
    store.commit({"a": spark.range(3)}, 0)
    with pytest.raises(Exception, match="no good"):
        store.commit({"a": spark.range(4), "b": spark.range(2).select(F.raise_error(F.lit("no good")).alias("x"))}, 1)
    assert store.latest() == 1 and store.read("a").count() == 3 and store.recover(0) == []
    os.makedirs(f"{store.path}/deadbeef/a")  # a writer that was killed before its commit
    assert store.recover(3600) == [] and store.recover(0) == ["deadbeef"] and store.read("a").count() == 3
    with pytest.raises(ValueError, match="schema version"):
        commits.Versions(spark, store.path, schema=2).read("a")


def test_changed_files_of_two_inventories(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert rows(maintenance.changed_files(old, new)) == [("added", "d"), ("deleted", "c"), ("modified", "b")]


def test_edges_of_messages_are_not_written_and_only_the_asked_table_is_maintained(spark):
    from factloom import structure_queries

    folder, app = "/root/testdata/sf0.001", spark.sparkContext.applicationId
    for name in ("kafka", "rest"):
        scratch.INDEXES.pop((app, folder, name), None)
    structure_queries.refreshed_kafka_edges(spark, folder)
    assert not {(app, folder, name) for name in ("kafka", "rest")} & set(scratch.INDEXES)


def test_endpoints_are_made_by_tasks_of_a_number_of_lines(spark, monkeypatch):
    from factloom.sources import facts

    monkeypatch.setattr(facts, "ROWS_A_TASK", 1000)
    made = facts.derived_endpoints(spark, "/root/testdata/sf0.001")
    n = facts.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert made.rdd.getNumPartitions() == -(-n // 1000) > 1 and made.count() == n


def test_lines_are_sent_once_for_their_endpoints(spark, monkeypatch):
    from factloom.sources import facts

    monkeypatch.setattr(facts, "ROWS_A_TASK", 1000)
    want = rows(facts.derived_endpoints(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(facts, "PARTS_SENT", 0)  # as with many parts
    made = facts.derived_endpoints(spark, "/root/testdata/sf0.001")
    assert rows(made) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "l_quantity" not in plan.split("Exchange")[0]  # lines and parts, each once


def test_kafka_edges_alone_are_refreshed_from_what_they_derive_from(spark, monkeypatch):
    rng = random.Random(3)
    before = drawn(rng, [f"f{k}" for k in range(30)])
    fresh = [r for r in before if r[6] in ("f1", "f2") and r[7] != 10]
    make = lambda r: spark.createDataFrame(r, COLUMNS)
    whole = make([r for r in before if r[6] not in ("f1", "f2")] + fresh)
    seen, plain = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, *a, **more: seen.append(set(df.columns)) or plain(df, *a, **more))
    got = maintenance.refreshed({"endpoints": make(before), "kafka": edges.kafka_edges(make(before))}, make(fresh), spark.createDataFrame([("f1",), ("f2",)], "path string"))
    assert rows(got["kafka"]) == rows(edges.kafka_edges(whole)) and rows(got["endpoints"]) == rows(whole)
    assert seen and not any({"snippet", "message_type", "end_line"} & columns for columns in seen)


def test_the_service_graph_makes_rest_edges_once(spark, monkeypatch):
    from factloom import queries

    folder, made, plain = "/root/testdata/sf0.001", [], edges.rest_edges
    monkeypatch.setattr(edges, "rest_edges", lambda *a: made.append(1) or plain(*a))
    scratch.INDEXES.pop((spark.sparkContext.applicationId, folder, "rest"), None)
    first = queries.service_graph(spark, folder)
    assert "rest-" in str(first.inputFiles()) and rows(first) == rows(queries.service_graph(spark, folder)) and len(made) == 1
