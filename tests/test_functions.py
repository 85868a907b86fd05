import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import ids, text


@pytest.mark.parametrize(
    ("call", "serve", "fits"),
    [
        ("GET /orders/1", "GET /orders/{id}", True),
        ("GET /orders/{x}", "GET /orders/7", True),
        ("POST /orders/1", "GET /orders/{id}", False),
        ("POST /orders/1", "ANY /orders/{id}", True),
        ("GET /orders", "GET /orders/{id}", False),
        ("GET /orders/1?a=b", "GET /orders/{id}", True),
        ("GET /api/orders/1", "ANY /api/**", True),
        ("GET /api", "ANY /api/**", False),
        ("GET <dynamic>", "GET /orders", False),
        ("GET /", "GET /", False),
    ],
)
def test_routes_match(spark, call, serve, fits):
    df = spark.createDataFrame([(call, serve)], "c string, s string")
    got = df.select(text.routes_match(text.method(F.col("c")), text.segments(F.col("c")), text.method(F.col("s")), text.segments(F.col("s")))).first()[0]
    assert got is fits


def test_ids(spark):
    df = spark.createDataFrame([("produce", "t", "p", 1, None), ("produce", "t", "p", None, None)], "role string, topic string, path string, a int, b int")
    got = [r[0] for r in df.select(ids.endpoint_id(*(F.col(c) for c in df.columns))).collect()]
    assert got == [hashlib.sha256(x).hexdigest()[:16] for x in (b"produce|t|p|1:1", b"produce|t|p")]


def test_globs_names_and_quantities(spark):
    df = spark.createDataFrame([("a/b/C.java", "250m", "128Mi", "orderCreatedEvent"), ("x.yml", "0.5", "2G", "HTTPRoute"), (None, "x", "1", None)], "p string, c string, m string, n string")
    rows = df.select(F.col("p").rlike(text.glob_pattern("a/*.java")), text.cpu_millicores(F.col("c")), text.memory_bytes(F.col("m")), text.screaming_snake(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(True, 250, 128 << 20, "ORDER_CREATED_EVENT"), (False, 500, 2_000_000_000, "HTTP_ROUTE"), (None, None, 1, None)]
    assert text.glob_pattern("[!a]?", "!") != text.glob_pattern("[!a]?")


def test_hints_and_ancestors(spark):
    df = spark.createDataFrame([("get(http://orders:80/x)",), ("uri: lb://pay",), ("domain=stock",), ("nothing",), (None,)], "s string")
    assert [r[0] for r in df.select(text.target_hint(F.col("s"))).collect()] == ["orders", "pay", "stock", None, None]
    assert spark.range(1).select(text.ancestors(F.lit("a/b/c"))).first()[0] == ["a/b", "a", "."]
