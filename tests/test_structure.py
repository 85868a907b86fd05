"""Layering, reachability labels, itineraries, types and contracts against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from factloom.operators import resolution, search
from factloom.plans import itineraries, layering, postings, traversals


def graph(rng, layers, width, p, rings=0):
    """A sparse layered graph with some rings inside its last layer."""
    pairs = {(f"n{a}_{i}", f"n{b}_{j}") for a in range(layers) for b in range(a + 1, min(layers, a + 3)) for i in range(width) for j in range(width) if rng.random() < p}
    for r in range(rings):
        own = [f"n{layers - 1}_{3 * r + k}" for k in range(3)]
        pairs |= set(zip(own, own[1:] + own[:1]))
    return sorted(pairs)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string").repartition(3)


def reach_of(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def walk(a):
        seen, todo = set(), [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    return {n: walk(n) for n in {x for p in pairs for x in p}}


def test_labels_equal_reachability_and_are_few(spark):
    rng = random.Random(1)
    for rings in (0, 3):
        pairs = graph(rng, 6, 12, 0.12, rings) + [("lone", "lone")]
        reach = reach_of(pairs)
        numbers, intervals = layering.reachability_labels(frame(spark, pairs))
        nodes = sorted(reach)
        asked = spark.createDataFrame([(a, b) for a in [*nodes, "none"] for b in [*nodes, "none"]], "source string, target string")
        got = {(r.source, r.target) for r in layering.reaches(asked, numbers, intervals).where("reached").collect()}
        assert got == {(a, b) for a in nodes for b in nodes if a == b or b in reach[a]}
        if rings:
            assert {r.component for r in layering.components_of(frame(spark, pairs)).groupBy("component").count().where("count = 3").collect()} == {f"n5_{3 * r}" for r in range(rings)}


def test_asked_pairs_are_searched_without_labels_in_more_than_one_block_and_from_either_side(spark):
    pairs = graph(random.Random(2), 6, 16, 0.12, 3) + [("lone", "lone")]
    reach = reach_of(pairs)
    nodes = sorted(reach)
    assert len(nodes) > 64
    truth = lambda some, others: {(a, b): a in reach and b in reach and (a == b or b in reach[a]) for a in some for b in others}
    for some, others in (([*nodes, "none"], nodes[:70]), (nodes[:9], [*nodes, "none"])):
        asked = spark.createDataFrame([(a, b) for a in some for b in others], "source string, target string")
        got = [(tuple(r)[:2], r.reached) for r in layering.reached(asked.union(asked), frame(spark, pairs)).collect()]
        assert len(got) == len(some) * len(others) and dict(got) == truth(some, others)


def test_labels_of_a_tree_like_graph_are_far_fewer_than_its_pairs(spark):
    pairs = [(f"a{k:03}", f"a{k + 1:03}") for k in range(5)] + [("a005", f"b{k:03}") for k in range(150)] + [(f"b{k:03}", f"c{k:03}") for k in range(150)] + [(f"b{k:03}", f"c{k + 1:03}") for k in range(0, 30, 3)]
    e = frame(spark, pairs)
    _, intervals = layering.reachability_labels(e)
    assert 10 * intervals.count() < 3 * traversals.reachable(e).count() and intervals.count() == 306 + 10


def test_postings_have_a_token_once_for_a_finding_and_texts_are_read_where_candidates_are_many(spark, tmp_path):
    rows = [(k, "the word the word", f"w{k % 3}") for k in range(12)] + [(12, "a word", "the")]
    findings = spark.createDataFrame(rows, "id long, message string, rule_id string")
    assert sorted((r.token, r.id) for r in postings.postings(findings.where("id > 10")).collect()) == [("a", 12), ("the", 11), ("the", 12), ("w2", 11), ("word", 11), ("word", 12)]
    postings.write_postings(findings, str(tmp_path / "p"))
    posted = spark.read.parquet(str(tmp_path / "p"))
    for most in (2, 5, 100):
        for query in ("the", "w1 the", "word"):
            hits = postings.posted_hits(findings, posted, query, most)
            plan = hits._jdf.queryExecution().optimizedPlan().toString()
            assert ("Join" in plan) == ({"the": 13, "w1 the": 4, "word": 13}[query] <= most)
            assert sorted((r.id, r.score) for r in hits.collect()) == sorted((r.id, r.score) for r in search.keyword_hits(findings, query).collect())


def test_a_score_is_made_once(spark):
    hits = search.keyword_hits(spark.createDataFrame([(1, "a b")], "id long, message string"), "a")
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower") == 1 and [r.score for r in hits.collect()] == [4 * (4 + 3 + 1)]


def plain_order(pairs):
    """One sweep from the first level on, as a plain program does it."""
    names = sorted({x for p in pairs for x in p})
    came, out = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        came[b].append(a)
        out[a].append(b)
    left = {n: len(came[n]) for n in names}
    level = {n: 0 for n in names if not left[n]}
    todo = sorted(level)
    for n in todo:
        for m in sorted(out[n]):
            level[m] = max(level.get(m, 0), level[n] + 1)
            left[m] -= 1
            if not left[m]:
                todo.append(m)
    level = {n: level[n] if left[n] == 0 else None for n in names}
    last = max((v for v in level.values() if v is not None), default=-1) + 1
    level = {n: last if v is None else v for n, v in level.items()}
    order = {n: k for k, n in enumerate(names)}
    for k in sorted(set(level.values())):
        own = sorted((n for n in names if level[n] == k), key=lambda n: (sum(order[p] for p in came[n]) / max(1, len(came[n])), n))
        order.update({n: i for i, n in enumerate(own)})
    widest = max(sum(v == k for v in level.values()) for k in level.values())
    return {(n, level[n], order[n], (widest - sum(v == level[n] for v in level.values())) * 0.5 + order[n]) for n in names}


def test_order_inside_levels_equals_a_plain_sweep(spark):
    rng = random.Random(2)
    for rings in (0, 2):
        pairs = graph(rng, 5, 9, 0.2, rings)
        assert {tuple(r) for r in layering.ordered_levels(frame(spark, pairs)).collect()} == plain_order(pairs)
    assert layering.ordered_levels(frame(spark, pairs).limit(0)).collect() == []


def test_condensed_graphs_have_summed_links_and_no_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "x"), ("b", "x"), ("x", "y"), ("y", "x"), ("c", "z"), ("x", "z"), ("s", "s"), ("s", "a")]
    got = {tuple(r) for r in layering.condensed(frame(spark, pairs)).collect()}
    assert got == {("a", "x", 2), ("a", "z", 1), ("x", "z", 1), ("s", "a", 1)}
    assert {tuple(r) for r in layering.component_levels(frame(spark, pairs)).collect()} == {("s", 1, 0), ("a", 3, 1), ("x", 2, 2), ("z", 1, 3)}


def shortest(pairs, a, b, most=12):
    best, at = {a: [a]}, [a]
    for _ in range(most):
        new = {}
        for n in at:
            for s, t in pairs:
                if s == n and t not in best and (t not in new or best[n] + [t] < new[t]):
                    new[t] = best[n] + [t]
        best |= new
        at = list(new)
    return best.get(b)


def test_itineraries_in_one_search(spark):
    rng = random.Random(3)
    pairs = graph(rng, 7, 6, 0.3, 1)
    links = frame(spark, pairs).withColumn("kind", F.lit("kafka")).union(spark.createDataFrame([("n0_0", "n6_0", "http"), ("n0_1", "n5_1", "http")], "source string, target string, kind string"))
    stops = [[f"n{layer}_{rng.randrange(6)}" for layer in sorted(rng.sample(range(7), rng.randrange(2, 5)))] for _ in range(30)]
    asked = spark.createDataFrame([(" -> ".join(s), s) for s in stops] + [("x", ["n0_0", "unknown"])], "query string, stops array<string>").distinct()
    got = {r.query: (r.path, r.depth) for r in itineraries.itineraries(links, asked, kinds=["kafka"]).collect()}
    for s in stops:
        legs = [shortest(pairs, a, b) for a, b in zip(s, s[1:])]
        want = legs[0] + [x for leg in legs[1:] for x in leg[1:]] if all(legs) else None
        assert got[" -> ".join(s)] == ((" > ".join(want), len(want) - 1) if want else (None, None))
    assert got["x"] == (None, None)
    near = {r.query: r.depth for r in itineraries.itineraries(links, asked.where("query = 'x'").select("query", F.array(F.lit("n0_0"), F.lit("n6_0")).alias("stops"))).collect()}
    assert near == {"x": 1}


def test_queries_of_itineraries_are_judged(spark):
    nodes = spark.createDataFrame([("Shop", "microservice"), ("Bank", "microservice"), ("orders", "kafka_topic"), ("db", "mongodb_collection"), ("twin", "microservice"), ("TWIN", "microservice"), ("post", "microservice"), ("post", "kafka_topic")], "name string, kind string")
    asked = ["shop -> orders -> bank", "Shop", "shop -> -> bank", "shop -> nowhere", "orders -> bank", "shop -> db -> bank", "shop -> twin", "shop -> bank -> shop", "shop->post", "shop -> post -> bank"]
    got = {r["query"]: (r["stops"], r["problem"]) for r in itineraries.parsed(spark.createDataFrame([(q,) for q in asked], "query string"), nodes).collect()}
    assert got == {
        "shop -> orders -> bank": (["Shop", "orders", "Bank"], None),
        "Shop": (None, "too few stops"),
        "shop -> -> bank": (None, "blank stop"),
        "shop -> nowhere": (None, "unknown name"),
        "orders -> bank": (None, "kind not allowed"),
        "shop -> db -> bank": (None, "kind not allowed"),
        "shop -> twin": (None, "ambiguous name"),
        "shop -> bank -> shop": (None, "repeated stop"),
        "shop->post": (["Shop", "post"], None),
        "shop -> post -> bank": (None, "ambiguous name"),
    }


def test_imported_types_by_rank(spark):
    types = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "X"), ("home", "X"), ("a", "Only"), ("", "Bare")], "package string, name string")
    imports = spark.createDataFrame([("f1", "b.X"), ("f1", "a.*"), ("f2", "a.*"), ("f2", "c.*"), ("f4", "nowhere.*"), ("f4", "nowhere.X")], "context string, imported string")
    rows = [("f1", "home", "X"), ("f2", "home", "X"), ("f3", "home", "X"), ("f3", "else", "X"), ("f3", "else", "c.X"), ("f3", "else", "Only"), ("f3", "else", "q$Only"), ("f4", "else", "X"), ("f3", "", "Bare"), (None, "home", "X")]
    got = {(r.context, r.package, r.type): (r.resolved, r.by) for r in resolution.resolve_imported_types(spark.createDataFrame(rows, "context string, package string, type string"), imports, types).collect()}
    want = [("b.X", "import"), ("a.X", "wildcard"), ("home.X", "package"), (None, None), ("c.X", "qualified"), ("a.Only", "only"), ("a.Only", "only"), (None, None), ("Bare", "qualified"), ("home.X", "package")]
    assert got == dict(zip(rows, want))


def test_persistence_classes_over_three_levels(spark):
    classes = ["s.Order", "s.Line", "s.Item", "s.Tag", "t.Tag", "t.Item", "u.Lone", "u.Other"]
    fields = [("s.Order", "lines", "List<Line>"), ("s.Line", "item", "t.Item"), ("s.Line", "again", "Item"), ("t.Item", "tags", "Set<Tag>"), ("t.Item", "lone", "Lone"), ("u.Lone", "tag", "Tag"), ("s.Item", "back", "Order"), ("u.Lone", "odd", "java.util.Line")]
    roots = [("orders", "s.Order"), ("items", "t.Item"), ("none", "no.Class")]
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in resolution.persistence_classes(f(roots, "collection string, qualified string"), f(fields, "qualified string, field string, type string"), f([(c,) for c in classes], "qualified string")).collect()}
    assert got == {
        ("orders", "s.Order", True, "s.Line"), ("orders", "s.Line", False, "s.Item,t.Item"), ("orders", "s.Item", False, "s.Order"), ("orders", "t.Item", False, "t.Tag,u.Lone"), ("orders", "t.Tag", False, ""),
        ("orders", "u.Lone", False, ""), ("items", "t.Item", True, "t.Tag,u.Lone"), ("items", "t.Tag", False, ""), ("items", "u.Lone", False, ""),
    }


def test_contracts_by_longest_overlap(spark):
    modules = [("one", "/repo/shop/model"), ("two", "/repo/model"), ("twin", "/other/model"), ("deep", "/repo/shop/model/deep")]
    wanted = {
        "model/api.yml": ("twin", "api.yml"),
        "shop/model/v1/api.yml": ("one", "v1/api.yml"),
        "./repo/model/api.yml": ("two", "api.yml"),
        "shop/model/deep/api.yml": ("deep", "api.yml"),
        "nowhere/api.yml": (None, "nowhere/api.yml"),
        "/repo/shop/model/deep/api.yml": ("one", "deep/api.yml"),
        "/model/api.yml": (None, "/model/api.yml"),
        "shop/model": ("one", "."),
    }
    got = resolution.contract_owners(spark.createDataFrame([(c,) for c in wanted], "contract string"), spark.createDataFrame(modules, "identity string, path string"))
    assert {r.contract: (r.owner, r.path) for r in got.collect()} == wanted


def test_posted_search_equals_the_whole_search(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta_1", "ÉTÉ", "字", "x-y", "42"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 7))), rng.choice(words), rng.choice(["INFO", "ERROR"]), f"p/{rng.choice(words)}.py") for k in range(150)] + [(200, None, None, "INFO", None)]
    findings = spark.createDataFrame(rows, "id long, message string, rule_id string, severity string, path string")
    postings.write_postings(findings, str(tmp_path / "p"))
    posted = spark.read.parquet(str(tmp_path / "p"))
    for query in ("alpha", "alpha beta", "GAMMA alpha p", "été", "字", "beta absent", "x-y", "--", "", "delta_1 42 py"):
        got = sorted((r.id, r.score) for r in postings.posted_hits(findings, posted, query).collect())
        assert got == sorted((r.id, r.score) for r in search.keyword_hits(findings, query).collect()), query
