import random

from factloom import queries
from factloom.plans import traversals


def plain_flows(pub, con, start, max_depth=6, limit=50):
    """A plain depth-first search; topics without a consumer give no path."""
    found = []

    def visit(nodes, depth):
        for m in sorted({m for m, t in con if t == nodes[-1]}):
            topics = sorted({t for n, t in pub if n == m})
            if depth >= max_depth or not topics:
                found.append((" > ".join([*nodes, m]), "depth" if topics else "leaf"))
                continue
            for t in topics:
                if t in nodes:
                    found.append((" > ".join([*nodes, m, t]), "cycle"))
                else:
                    visit([*nodes, m, t], depth + 1)

    visit([start], 1)
    return [(*f, len(found) > limit) for f in found[:limit]]


def test_flows_against_plain_python(spark):
    rng = random.Random(3)
    chain = ([(f"m{k}", f"t{k + 1}") for k in range(8)], [(f"m{k}", f"t{k}") for k in range(8)])
    wild = tuple([(f"m{rng.randrange(9)}", f"t{rng.randrange(9)}") for _ in range(18)] for _ in range(2))
    for pub, con in (chain, wild):
        a, b = (spark.createDataFrame(x, "module string, topic string") for x in (pub, con))
        for limit in (50, 3):
            assert [tuple(r) for r in traversals.flows(a, b, "t0", limit=limit).collect()] == plain_flows(pub, con, "t0", limit=limit)


def test_flows_search_on_where_first_paths_end_nothing(spark):
    """Many early branches lead to topics that nothing reads; the search widens until the later endings are known."""
    pub = [("m", f"a{k:03}") for k in range(200)] + [(f"c{k:03}", f"dead{k}") for k in range(200)] + [("m", "z")]
    con = [("m", "t0")] + [(f"c{k:03}", f"a{k:03}") for k in range(200)] + [("end", "z")]
    a, b = (spark.createDataFrame(x, "module string, topic string") for x in (pub, con))
    got = [tuple(r) for r in traversals.flows(a, b, "t0", limit=2).collect()]
    assert got == plain_flows(pub, con, "t0", limit=2) == [("t0 > m > z > end", "leaf", False)]


def test_simple_paths_against_plain_python(spark):
    rng = random.Random(4)
    pairs = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(26)})
    found = []

    def visit(nodes):
        if nodes[-1] == "n8":
            found.append(" > ".join(nodes))
        elif len(nodes) <= 5:
            for a, b in pairs:
                if a == nodes[-1] and b not in nodes:
                    visit([*nodes, b])

    visit(["n0"])
    e = spark.createDataFrame(pairs, "source string, target string")
    got = traversals.simple_paths(e, "n0", "n8", max_depth=5, limit=4).collect()
    assert [r.path for r in got] == sorted(found)[:4] and all(r.truncated == (len(found) > 4) for r in got)
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    assert [tuple(r) for r in traversals.itinerary(line, "a -> b -> c -> a").collect()] == [(1, "a > b", 1), (2, "b > c", 1)]


def test_parallel_edges_give_paths_of_their_own(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 3)], "source string, target string, id long")
    assert [tuple(r) for r in traversals.shortest_paths(e, "a", "c").collect()] == [(2, "a > b > c", "1 > 3", False), (2, "a > b > c", "2 > 3", False)]


def test_registered_traversals_have_the_references_bounds(spark, monkeypatch):
    given = []
    for name in ("flows", "shortest_paths"):
        monkeypatch.setattr(traversals, name, lambda *a, **more: given.append(more))
    for name in ("topic_flows", "shortest_paths"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert given == [{}, {}]


def test_all_roots_and_edges_are_taken(spark, monkeypatch):
    pairs = sorted({(f"s{rng.randrange(12)}", f"s{rng.randrange(12)}") for rng in [random.Random(8)] for _ in range(14)} | {("s3", "s1"), ("s1", "s3")})
    dep = spark.createDataFrame(pairs, "source string, target string")
    monkeypatch.setattr(queries.facts, "module_dependencies", lambda *_: dep)
    monkeypatch.setattr(queries.facts, "endpoints", lambda *_: dep)
    monkeypatch.setattr(queries.edges, "kafka_edges", lambda e: e)
    got = {name: {tuple(r) for r in queries.QUERIES[name](spark, "").collect()} for name in ("all_module_closures", "all_topology_levels", "all_kafka_fan_out")}
    reach = {(a, a) for a, _ in pairs}
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    assert got["all_module_closures"] == reach
    assert got["all_kafka_fan_out"] == {(a, sum(b == a for b, _ in pairs)) for a, _ in pairs}
    left, edges_, level, k = {x for p in pairs for x in p}, {p for p in pairs if p[0] != p[1]}, {}, 0
    while left:
        free = left - {t for s, t in edges_ if s in left} or left
        level |= dict.fromkeys(free, k)
        left, k = left - free, k + 1
    assert got["all_topology_levels"] == set(level.items())
