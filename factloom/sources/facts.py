"""Facts derived from the star-schema tables, so that every operator has whole tables to work on.

A line item is an endpoint: returned lines consume, new ones produce, the rest call or serve HTTP
routes; its part names the topic or route, its supplier the service, its order the file. Endpoints
and dependencies are derived once for a session and folder and written as tables (an index); queries
scan those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.ids import endpoint_id
from factloom.scratch import index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(x) -> F.Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


#: Line items that one task makes endpoints of; up to so many parts are sent to all tasks.
ROWS_A_TASK, PARTS_SENT = 500_000, 100_000


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoints of all line items, from the index."""
    return index(spark, sf_dir, "endpoints", lambda: derived_endpoints(spark, sf_dir), ["lineitem", "part"], by=("system", "role"), order=("topic",))


def derived_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, role, system, topic, topic_dynamic, source, path, start_line, end_line, snippet, module, message_type."""
    # Only what endpoints are told by is sent: of amounts, which side of their bounds they are on.
    told = {"even": F.col("l_quantity").cast("int") % 2 == 0, "dynamic": F.col("l_discount") >= 0.09, "declared": F.col("l_tax") >= 0.07, "typed": F.col("l_tax") >= 0.01}
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", *(c.alias(name) for name, c in told.items()))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    # The writer sorts a task's endpoints, which are several times as wide as their lines: so tasks are cut by rows, not by the files' size.
    tasks = -(-li.count() // ROWS_A_TASK) or 1
    if part.count() <= PARTS_SENT:
        x = li.repartition(tasks, "l_orderkey", "l_linenumber").join(F.broadcast(part), F.col("l_partkey") == F.col("p_partkey"))
    else:  # dealt by the join's own key, so that lines are sent once
        x = li.repartition(tasks, "l_partkey").join(part.repartition(tasks, "p_partkey").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    role = F.when(F.col("l_returnflag") == "N", "produce").when(F.col("l_returnflag") == "R", "consume").when(F.col("even"), "serve").otherwise("call")
    x = x.withColumn("role", role).withColumn("system", F.when(F.col("l_returnflag") == "A", "rest").otherwise("kafka"))
    size = text("p_size")
    gateway = (F.col("role") == "call") & (F.col("p_size") % 17 == 0)
    verb = F.when((F.col("role") == "serve") & (F.col("p_size") % 7 == 0) | gateway, "ANY").when(F.col("l_linenumber") % 2 == 0, "GET").otherwise("POST")
    last = F.when(F.col("role") == "serve", F.when(F.col("p_size") % 3 == 0, F.lit("{id}")).otherwise(size)).when(gateway, "**").otherwise(F.concat(size, F.when(F.col("p_size") % 10 == 0, F.lit("?page=1")).otherwise(F.lit(""))))
    dynamic = F.col("dynamic")
    route = F.concat(verb, F.lit(" /"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit("/"), last)
    route = F.when((F.col("role") != "call") | ~dynamic, route).when(F.col("l_linenumber") % 2 == 0, F.concat(verb, F.lit(" <dynamic>"))).otherwise(F.concat(route, F.lit(" <dynamic>")))
    key = text(F.col("l_partkey") % 100)
    ways = ["external=partner-", "lb://SVC-", "https://zone-", "domain=svc-", "https://solo-", "https://nowhere-", "client.call("]
    way = F.get(F.array(*(F.lit(x) for x in ways)), (F.col("l_partkey") % 20).cast("int"))
    called = F.when(way == ways[0], F.concat(way, text(F.col("l_partkey") % 5))).when(way == ways[2], F.concat(way, text(F.col("l_partkey") % 7))).when(way.isNotNull(), F.concat(way, key)).otherwise(F.concat(F.lit("get(http://svc-"), key, F.lit("/x)")))
    kind = F.concat("p_type", F.when((F.col("role") == "consume") & (F.col("p_size") % 9 == 0), F.lit(" V2")).otherwise(F.lit("")))
    topic = F.concat("p_brand", F.lit("/"), size, F.lit("/"), text(F.col("l_partkey") % 8))
    x = x.select(
        "role",
        "system",
        F.when(F.col("system") == "rest", route).otherwise(topic).alias("topic"),
        dynamic.alias("topic_dynamic"),
        F.when(F.col("declared"), "manifest").otherwise("code").alias("source"),
        F.concat(F.lit("o/"), text("l_orderkey"), F.lit(".java")).alias("path"),
        (F.col("l_linenumber") * 10).cast("int").alias("start_line"),
        (F.col("l_linenumber") * 10 + F.when(F.col("role") == "consume", 25).otherwise(0)).cast("int").alias("end_line"),
        F.when(F.col("role") == "call", called).otherwise(F.concat(F.lit("@Value(${app."), F.lower("p_type"), F.lit("})"))).alias("snippet"),
        F.concat(F.lit("svc-"), text("l_suppkey")).alias("module"),
        F.when((F.col("system") == "kafka") & F.col("typed"), kind).alias("message_type"),
    )
    return x.select(endpoint_id(F.col("role"), F.col("topic"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"), "*")


ENDPOINTS_SQL = """
ep as (
  select substr(sha256(concat(role, '|', topic, '|', path, '|', cast(start_line as varchar), ':', cast(end_line as varchar))), 1, 16) as id, * from (
    select role, system, case when system <> 'rest' then concat(p_brand, '/', cast(p_size as varchar), '/', cast(l_partkey % 8 as varchar))
        when role <> 'call' or l_discount < 0.09 then route when l_linenumber % 2 = 0 then concat(verb, ' <dynamic>') else concat(route, ' <dynamic>') end as topic,
      l_discount >= 0.09 as topic_dynamic, case when l_tax >= 0.07 then 'manifest' else 'code' end as source,
      concat('o/', cast(l_orderkey as varchar), '.java') as path, cast(l_linenumber * 10 as integer) as start_line,
      cast(l_linenumber * 10 + case when role = 'consume' then 25 else 0 end as integer) as end_line,
      case when role <> 'call' then concat('@Value(${app.', lower(p_type), '})') else case l_partkey % 20
        when 0 then concat('external=partner-', cast(l_partkey % 5 as varchar)) when 1 then concat('lb://SVC-', cast(l_partkey % 100 as varchar))
        when 2 then concat('https://zone-', cast(l_partkey % 7 as varchar)) when 3 then concat('domain=svc-', cast(l_partkey % 100 as varchar))
        when 4 then concat('https://solo-', cast(l_partkey % 100 as varchar)) when 5 then concat('https://nowhere-', cast(l_partkey % 100 as varchar))
        when 6 then concat('client.call(', cast(l_partkey % 100 as varchar)) else concat('get(http://svc-', cast(l_partkey % 100 as varchar), '/x)') end end as snippet,
      concat('svc-', cast(l_suppkey as varchar)) as module,
      case when system = 'kafka' and l_tax >= 0.01 then concat(p_type, case when role = 'consume' and p_size % 9 = 0 then ' V2' else '' end) end as message_type
    from (
      select *, concat(verb, ' /', lower(replace(p_brand, '#', '')), '/', last_) as route from (
        select *, case when role = 'serve' and p_size % 7 = 0 or role = 'call' and p_size % 17 = 0 then 'ANY' when l_linenumber % 2 = 0 then 'GET' else 'POST' end as verb,
          case when role = 'serve' then case when p_size % 3 = 0 then '{id}' else cast(p_size as varchar) end
               when role = 'call' and p_size % 17 = 0 then '**'
               else concat(cast(p_size as varchar), case when p_size % 10 = 0 then '?page=1' else '' end) end as last_
        from (
          select *, case when l_returnflag = 'N' then 'produce' when l_returnflag = 'R' then 'consume' when cast(l_quantity as integer) % 2 = 0 then 'serve' else 'call' end as role,
            case when l_returnflag = 'A' then 'rest' else 'kafka' end as system
          from lineitem join part on l_partkey = p_partkey) a) b) c) d)
"""


def module_dependencies(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """source, target: suppliers of consecutive lines of an order, from the index.

    ``whole``: all pairs of two suppliers. Else a layered part of them, for queries over levels:
    suppliers lie on eight layers by their number. A pair counts where the second one lies one or two
    layers on and their numbers fit, which gives a sparse graph without cycles; on the last two
    layers every other group of three suppliers is a ring.
    """

    def derived() -> DataFrame:
        li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("s"))
        both = a.join(li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("t")), ["l_orderkey", "l_linenumber"])
        names = (F.concat(F.lit("svc-"), text("s")).alias("source"), F.concat(F.lit("svc-"), text("t")).alias("target"))
        if whole:
            return both.where("s <> t").select("s", "t").distinct().select(*names)
        on = F.col("t") % 8 - F.col("s") % 8
        ring = (on == 0) & (F.col("s") % 8 >= 6) & (F.floor(F.col("s") / 24) == F.floor(F.col("t") / 24)) & (F.floor(F.col("s") / 24) % 2 == 0) & (F.col("t") - F.col("s")).isin(8, -16)
        kept = both.where(on.isin(1, 2) & ((F.col("s") + F.col("t")) % 7).isin(0, 3) | ring)
        return kept.select(*names).distinct()

    return index(spark, sf_dir, "all-dependencies" if whole else "dependencies", derived, ["lineitem"])


DEPENDENCIES_SQL = """
dep as (
  select distinct concat('svc-', cast(a.l_suppkey as varchar)) as source, concat('svc-', cast(b.l_suppkey as varchar)) as target
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where b.l_suppkey % 8 - a.l_suppkey % 8 in (1, 2) and (a.l_suppkey + b.l_suppkey) % 7 in (0, 3)
    or b.l_suppkey % 8 = a.l_suppkey % 8 and a.l_suppkey % 8 >= 6 and a.l_suppkey // 24 = b.l_suppkey // 24 and a.l_suppkey // 24 % 2 = 0 and b.l_suppkey - a.l_suppkey in (8, -16))
"""

ALL_DEPENDENCIES_SQL = """
dep as (
  select distinct concat('svc-', cast(a.l_suppkey as varchar)) as source, concat('svc-', cast(b.l_suppkey as varchar)) as target
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_suppkey <> b.l_suppkey)
"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service, alias: each service's own declared name, and the name of its zone, which others share."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    service = F.concat(F.lit("svc-"), text("s_suppkey"))
    return s.select(service.alias("service"), F.explode(F.array(F.concat(F.lit("solo-"), text("s_suppkey")), F.concat(F.lit("Zone-"), text(F.col("s_suppkey") % 7)))).alias("alias"))


ALIASES_SQL = """
aliases as (
  select concat('svc-', cast(s_suppkey as varchar)) as service, concat('solo-', cast(s_suppkey as varchar)) as alias from supplier
  union all select concat('svc-', cast(s_suppkey as varchar)), concat('Zone-', cast(s_suppkey % 7 as varchar)) from supplier)
"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity, name, kind, starts_application, namespace of every supplier as a module."""
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    kind = F.when(n % 10 == 9, "aggregator").when(F.col("s_acctbal") > 0, "application").otherwise("library")
    ends = F.get(F.array(*(F.lit(x) for x in ("", "-repository", "-api", "-infra", "-contract", ""))), (n % 6).cast("int"))
    name = F.concat(F.when(n % 4 == 0, F.lit("domain-")).otherwise(F.lit("")), F.lit("m"), text("s_suppkey"), ends)
    space = F.get(F.array(F.lit("portail"), F.lit("Cycle-de-vie"), F.lit("core"), F.lit("core")), (F.col("s_nationkey") % 4).cast("int"))
    return s.select(F.concat(F.lit("svc-"), text("s_suppkey")).alias("identity"), name.alias("name"), kind.alias("kind"), ((F.col("s_acctbal") > 0) & (n % 10 != 9)).alias("starts_application"), space.alias("namespace"))


MODULES_SQL = """
modules as (
  select concat('svc-', cast(s_suppkey as varchar)) as identity,
    concat(case when s_suppkey % 4 = 0 then 'domain-' else '' end, 'm', cast(s_suppkey as varchar), case s_suppkey % 6 when 1 then '-repository' when 2 then '-api' when 3 then '-infra' when 4 then '-contract' else '' end) as name,
    case when s_suppkey % 10 = 9 then 'aggregator' when s_acctbal > 0 then 'application' else 'library' end as kind,
    s_acctbal > 0 and s_suppkey % 10 <> 9 as starts_application,
    case s_nationkey % 4 when 0 then 'portail' when 1 then 'Cycle-de-vie' else 'core' end as namespace
  from supplier)
"""


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module, collection, operation, path, start_line of every event: a use of a stored collection."""
    e = table(spark, sf_dir, "events")
    verbs = ["save", "insert", "updateFirst", "remove", "findById", "findAll", "count", "bulkOps"]
    way = F.get(F.array(*(F.lit(v) for v in verbs)), (F.col("event_id") % 8).cast("int"))
    return e.select(F.concat(F.lit("svc-"), text(F.col("user_id") % 100)).alias("module"), F.col("event_type").alias("collection"), way.alias("operation"), F.concat(F.lit("e/"), text("event_id"), F.lit(".java")).alias("path"), (F.col("event_id") % 300 + 1).cast("int").alias("start_line"))


COLLECTIONS_SQL = """
coll as (
  select concat('svc-', cast(user_id % 100 as varchar)) as module, event_type as collection,
    case event_id % 8 when 0 then 'save' when 1 then 'insert' when 2 then 'updateFirst' when 3 then 'remove' when 4 then 'findById' when 5 then 'findAll' when 6 then 'count' else 'bulkOps' end as operation,
    concat('e/', cast(event_id as varchar), '.java') as path, cast(event_id % 300 + 1 as integer) as start_line
  from events)
"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rule_id, severity, message, path, start_line, cwe of every document: its source is the rule, its text the message."""
    d = table(spark, sf_dir, "documents")
    severity = F.when(F.col("doc_id") % 3 == 0, "ERROR").when(F.col("doc_id") % 3 == 1, "WARNING").otherwise("INFO")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("rule_id"), severity.alias("severity"), F.coalesce("text", F.lit("")).alias("message"), F.concat("lang", F.lit("/"), "source", F.lit("/f"), text("doc_id"), F.lit(".py")).alias("path"), (F.col("n_chars") % 500).cast("int").alias("start_line"), F.concat(F.lit("CWE-"), text(F.col("doc_id") % 90)).alias("cwe"))


FINDINGS_SQL = """
fi as (
  select doc_id as id, source as rule_id, case when doc_id % 3 = 0 then 'ERROR' when doc_id % 3 = 1 then 'WARNING' else 'INFO' end as severity, coalesce(text, '') as message,
    concat(lang, '/', source, '/f', cast(doc_id as varchar), '.py') as path, cast(n_chars % 500 as integer) as start_line, concat('CWE-', cast(doc_id % 90 as varchar)) as cwe
  from documents)
"""
