"""Queries over dependencies take all of them, and closures are searched over components."""

import random

from pyspark.sql import functions as F

from factloom import inventory_queries, queries, scratch  # noqa: F401  the first registers its queries
from factloom.operators import resolution
from factloom.plans import traversals
from factloom.sources import facts

SF = "/root/testdata/sf0.001"


def all_pairs(spark):
    rows = facts.table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").collect()
    at = {}
    for order, line, s in rows:
        at.setdefault((order, line), set()).add(s)
    return {(f"svc-{s}", f"svc-{t}") for order, line in at for s in at[order, line] for t in at.get((order, line + 1), ()) if s != t}


def test_all_dependencies_are_the_pairs_of_consecutive_lines(spark):
    want = all_pairs(spark)
    assert {tuple(r) for r in facts.module_dependencies(spark, SF, True).collect()} == want
    used = {tuple(r) for r in queries.neighbors(spark, SF).where("relation = 'depends_on'").select("name", "other").collect()}
    assert used == want
    rel = queries.architecture_relations(spark, SF).where("relation = 'depends_on'").select("source_name", "target_name")
    assert {tuple(r) for r in rel.collect()} == want
    for name in ("module_summary", "neighbors", "impact", "architecture_relations", "coverage_counts", "reachable", "strong_components", "module_closures", "shown_objects"):
        assert queries.ALL_DEP in queries.ORACLE_SQL[name] and queries.DEP not in queries.ORACLE_SQL[name], name


def plain_closure(pairs):
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    return reach


def test_closures_over_components_equal_plain_ones(spark):
    for seed, n in ((1, 14), (2, 30), (3, 60)):
        rng = random.Random(seed)
        pairs = {(f"s{rng.randrange(25)}", f"s{rng.randrange(25)}") for _ in range(n)} | {("x", "x"), ("y", "x")}
        edges = spark.createDataFrame(sorted(pairs), "source string, target string")
        want = plain_closure(pairs)
        got = [tuple(r) for r in traversals.reachable(edges).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        roots = [("a", "s1"), ("a", "s2"), ("b", "s3"), ("c", "nowhere"), ("d", "x")]
        got = [tuple(r) for r in resolution.closures(spark.createDataFrame(roots, "root string, node string"), edges).collect()]
        assert len(got) == len(set(got)) and set(got) == set(roots) | {(root, t) for root, node in roots for s, t in want if s == node}


def test_pairs_of_a_large_component_are_not_written(spark, monkeypatch):
    n, counted = 300, []
    plain = scratch.written

    def written(df, *a, **more):
        counted.append(df.count())
        return plain(df, *a, **more)

    monkeypatch.setattr(scratch, "written", written)
    ring = [(f"s{a}", f"s{(a + step) % n}") for a, step in [*((a, 1) for a in range(n)), *((a, 7) for a in range(n))]]
    edges = spark.createDataFrame(ring, "source string, target string")
    out = traversals.reachable(edges)
    assert max(counted) <= len(ring) and out.count() == n * n
    assert out.select(F.count_distinct("source", "target")).first()[0] == n * n


def test_sides_of_messages_are_those_of_the_edges(spark):
    from factloom.operators import edges

    rng = random.Random(4)
    rows = [(str(k), rng.choice(["produce", "consume"]), "kafka", f"t{rng.randrange(12)}", rng.random() < 0.1, rng.choice(["manifest", "code"]), rng.choice([None, "a", "b", "c", "d"])) for k in range(60)]
    e = spark.createDataFrame(rows, "id string, role string, system string, topic string, topic_dynamic boolean, source string, module string")
    whole = edges.kafka_edges(e).collect()
    want = {(r.source, None, r.topic) for r in whole} | {(None, r.target, r.topic) for r in whole}
    got = [tuple(r) for r in edges.kafka_sides(e).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_legs_with_one_end_share_their_search(spark, monkeypatch):
    from factloom.plans import itineraries

    n, counted, plain = 60, [], scratch.written

    def written(df, *a, **more):
        counted.append(df.count())
        return plain(df, *a, **more)

    monkeypatch.setattr(scratch, "written", written)
    links = [(f"a{k:02}", "m1") for k in range(n)] + [(f"a{k:02}", "m2") for k in range(n)] + [("m1", f"b{k:02}") for k in range(n)] + [("m2", "z")] + [(f"b{k:02}", "z") for k in range(n)]
    asked = spark.createDataFrame([(f"q{k}", [f"a{k:02}", "z"]) for k in range(n)], "query string, stops array<string>")
    got = itineraries.itineraries(spark.createDataFrame(links, "source string, target string"), asked).collect()
    assert {(r.query, r.path, r.depth) for r in got} == {(f"q{k}", f"a{k:02} > m2 > z", 2) for k in range(n)}
    assert max(counted) <= len(links)  # sixty legs times sixty nodes were written


def test_a_repeated_id_stays_once_in_federations_and_their_sql(spark, tmp_path):
    import duckdb

    t = lambda name: facts.table(spark, SF, name)
    t("lineitem").union(t("lineitem").limit(50)).write.parquet(f"{tmp_path}/lineitem.parquet")
    t("part").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    for name in ("lineitem", "part"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("federated_endpoints", "federated_relations"):
        got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(db.execute(queries.ORACLE_SQL[name]).fetchall()) and len({r[0] for r in got}) == len(got)


def test_pairs_of_services_equal_those_of_the_edges(spark, monkeypatch):
    from factloom.operators import edges

    monkeypatch.setattr(edges, "SOURCE_BLOCKS", 3)
    monkeypatch.setattr(edges, "TARGET_ROWS", 7)
    rng = random.Random(5)
    rows = [(str(k), rng.choice(["produce", "consume"]), "kafka", f"t{rng.randrange(9)}", rng.random() < 0.1, rng.choice(["manifest", "code"]), rng.choice([None, *"abcdefgh"])) for k in range(120)]
    e = spark.createDataFrame(rows, "id string, role string, system string, topic string, topic_dynamic boolean, source string, module string")
    got = [tuple(r) for r in edges.kafka_pairs(e).collect()]
    assert len(got) == len(set(got)) and set(got) == {(r.source, r.target) for r in edges.kafka_edges(e).collect()}
    assert edges.kafka_pairs(e.limit(0)).collect() == []
    counts = edges.kafka_fan_out(e).collect()
    assert len({r.source for r in counts}) == len(counts) and {(r.source, r.targets) for r in counts} == {(s, sum(a == s for a, _ in got)) for s, _ in got}
    assert edges.kafka_fan_out(e.limit(0)).collect() == []


def test_fan_out_counts_pairs_in_blocks_of_a_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    from factloom.operators import edges

    monkeypatch.setattr(edges, "PAIRS_A_BATCH", 4)
    rows = pa.record_batch({"role": ["produce"] * 2 + ["consume"] * 9, "topic": ["t"] * 11, "module": ["a", "z", *(f"b{k}" for k in range(8)), "a"]})
    made = list(edges._pairs_of_block(iter([rows])))
    assert max(b.num_rows for b in made) <= 4 and sum(b.num_rows for b in made) == 8 + 9
    assert [b.to_pydict() for b in edges._counts_of_block(iter([rows]))] == [{"source": ["a", "z"], "targets": [8, 9]}]
    plan = queries.all_kafka_fan_out(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "target#" not in plan  # no pair leaves its block


def test_relations_are_sent_only_where_ids_repeat(spark, monkeypatch):
    from factloom.operators import relations

    rng = random.Random(6)
    rows = [(rng.choice(["produce", "consume"]), "kafka", rng.choice([None, "t", "u"]), rng.random() < 0.2, rng.choice(["manifest", "code"]), rng.choice([None, f"f{k // 3}", f"f{k // 3}"]), rng.choice([None, 10, 20]), rng.choice(["${k}", "${k} ${z}", None]), rng.choice(["a", "b", "c", None]), rng.choice([None, "T"])) for k in range(90)]
    rows += [("produce", "kafka", f"t{k}", False, "code", f"g{k}", 10, "${k}", "a", "T") for k in range(60)]  # nothing else is there
    e = spark.createDataFrame(rows, "role string, system string, topic string, topic_dynamic boolean, source string, path string, start_line int, snippet string, module string, message_type string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), (None, "c")], "source string, target string")
    uses = spark.createDataFrame([("a", "c", "save", "x", 1), ("a", "c", "save", "x", 1), ("a", "c", "count", "x", 1), ("b", None, "save", "y", None)], "module string, collection string, operation string, path string, start_line int")
    run = spark.createDataFrame([("a",), ("a",)], "module string")
    sent, plain = [], relations._last_written
    monkeypatch.setattr(relations, "_last_written", lambda df: sent.append(df.count()) or plain(df))
    made = lambda **more: sorted((tuple(r) for r in relations.architecture_relations(e, pairs, run, pairs, pairs, collections=uses, **more).collect()), key=repr)
    got = made()
    monkeypatch.setattr(relations, "NAMES_SENT", 0)  # too many repeat: all are sent
    assert got == made() and len({r[0] for r in got}) == len(got)
    assert sent[0] <= sent[1] - 180
    some = made(only=["reads", "writes"])
    assert [r for r in some if r[0]] == [r for r in got if r[0] and r[3] in ("reads", "writes")]


def test_relations_are_neither_written_nor_counted_one_by_one(spark, monkeypatch):
    from factloom.operators import edges

    monkeypatch.setattr(edges, "kafka_pairs", lambda *_: 1 / 0)
    want = {(r.measure, r.value): r.n for r in queries.coverage_counts(spark, SF).collect()}
    monkeypatch.undo()
    got = queries.architecture_relations(spark, SF).groupBy("relation").count().collect()
    assert {("relations", r.relation): r["count"] for r in got} == {k: n for k, n in want.items() if k[0] == "relations"}
    assert (spark.sparkContext.applicationId, SF, "relations") not in scratch.INDEXES


def test_thinned_edges_reach_the_same_and_whole_graphs_are_searched_by_tasks(spark, monkeypatch):
    for seed, n, room in ((1, 40, 2_000_000), (2, 70, 9), (3, 200, 25), (4, 30, 4)):
        monkeypatch.setattr(traversals, "EDGES_A_TASK", room)
        rng = random.Random(seed)
        pairs = {(f"s{rng.randrange(24)}", f"s{rng.randrange(24)}") for _ in range(n)} | {("x", "x"), ("y", "x")}
        edges = spark.createDataFrame(sorted(pairs) * 2, "source string, target string")
        want = plain_closure(pairs)
        assert plain_closure({tuple(r) for r in traversals.thinned(edges).collect()}) == want
        of = {a: min(b for b in {a} | {b for c, b in want if c == a and (b, a) in want}) for a in {a for p in pairs for a in p}}
        big = {a: c for a, c in of.items() if list(of.values()).count(c) > 1}
        assert {r.node: r.component for r in traversals.strong_components(edges).collect()} == big


def test_a_dense_graph_is_thinned_before_it_is_sent_about(spark, monkeypatch):
    n, counted, plain = 60, [], scratch.written

    def written(df, *a, **more):
        counted.append(df.count())
        return plain(df, *a, **more)

    monkeypatch.setattr(scratch, "written", written)
    edges = spark.createDataFrame([(f"s{a}", f"s{b}") for a in range(n) for b in range(n) if a != b], "source string, target string")
    assert traversals.reachable(edges).count() == n * n
    roots = edges.select(F.col("source").alias("root"), F.col("source").alias("node"))
    assert resolution.closures(roots, edges).count() == n * n
    assert max(counted) <= 2 * n


def test_lists_of_services_are_joined_in_blocks_of_ranges(spark, monkeypatch):
    from factloom import summary_queries
    from factloom.operators import edges

    monkeypatch.setattr(edges, "SOURCE_BLOCKS", 3)
    monkeypatch.setattr(edges, "TARGET_ROWS", 7)
    monkeypatch.setattr(edges, "CHARACTERS_A_BATCH", 5)
    rng = random.Random(7)
    rows = [(str(k), rng.choice(["produce", "consume"]), "kafka", f"t{rng.randrange(9)}", rng.random() < 0.1, "code", rng.choice([None, *"abcdefgh"])) for k in range(60)]
    e = spark.createDataFrame(rows, "id string, role string, system string, topic string, topic_dynamic boolean, source string, module string")
    calls = {("a", "x"), ("y", "b"), ("y", "x"), ("a", "b")}
    rest = spark.createDataFrame(sorted(calls) * 2, "source string, target string")
    want = {(r.source, r.target) for r in edges.kafka_edges(e).collect()} | calls
    joined = lambda names: ",".join(sorted(names)) or None
    got = edges.neighbour_lists(e, rest)
    assert sorted(tuple(r) for r in got.collect()) == sorted((m, joined(t for s, t in want if s == m), joined(s for s, t in want if t == m)) for m in {x for pair in want for x in pair})
    plan = summary_queries.service_cards(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(to" not in plan  # no set of names
