"""More registered queries: listings, collections, samples, manifests of facts, federation, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import audit, deltas, filters, resolution, search
from factloom.plans import catalog, traversals
from factloom.queries import ALL_NEIGHBOURS, COLL, DEPENDENCY_EDGES, EFFECTIVE, EP, FI, KAFKA, LINKS, MOD, REST, WHOLE, _links, dependency_graph, query, rest_index
from factloom.sources import facts, manifests

WRITES_SQL = "operation in ('bulkOps', 'findAndModify', 'findAndReplace', 'insert', 'remove', 'save', 'updateFirst', 'updateMulti', 'upsert')"


@query(f"""with {EP}, {MOD}, {COLL} select 'microservice' as kind, identity as name from modules where starts_application union all select 'module', identity from modules
  union all select distinct 'topic', topic from ep where system = 'kafka' union all select distinct 'api', topic from ep where system = 'rest' union all select distinct 'collection', collection from coll
  union all select distinct 'dto', message_type from ep where system = 'kafka' and message_type <> '' union all select distinct 'endpoint', id from ep""")
def object_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = facts.endpoints(spark, sf_dir), facts.modules(spark, sf_dir), facts.collections(spark, sf_dir)
    out = catalog.list_objects(catalog.KINDS[0], *tables)
    for kind in catalog.KINDS[1:]:
        out = out.union(catalog.list_objects(kind, *tables))
    return out


@query(f"{ALL_NEIGHBOURS} select near.* from near join (select distinct 'topic' as kind, concat(p_brand, '/', cast(p_size as varchar), '/0') as name from part union select 'module', concat('svc-', cast(n_nationkey as varchar)) from nation) w on near.kind = w.kind and near.name = w.name")
def shown_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = facts.table(spark, sf_dir, "part").select(F.lit("topic").alias("kind"), F.concat("p_brand", F.lit("/"), facts.text("p_size"), F.lit("/0")).alias("name"))
    wanted = wanted.union(facts.table(spark, sf_dir, "nation").select(F.lit("module"), F.concat(F.lit("svc-"), facts.text("n_nationkey"))))
    return catalog.show_objects(wanted, catalog.neighbours(facts.endpoints(spark, sf_dir), facts.module_dependencies(spark, sf_dir, WHOLE)))


@query(f"with {EP}, {REST} select distinct module, topic as api from ep where system = 'rest' and role = 'call' and module is not null and not exists (select 1 from rest r where r.call_id = ep.id and r.source = ep.module)")
def external_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.external_apis(facts.endpoints(spark, sf_dir), rest_index(spark, sf_dir))


@query(f"with {MOD}, {COLL} select collection, string_agg(distinct module, ',' order by module) as modules, coalesce(string_agg(distinct module, ',' order by module) filter (starts_application), '') as services, count(*) as operations from coll join modules on identity = module group by collection")
def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_summary(facts.collections(spark, sf_dir), facts.modules(spark, sf_dir))


@query(f"with {COLL} select distinct concat(module, ':', collection) as node, module, collection, case when {WRITES_SQL} then 'writes' else 'reads' end as access from coll")
def collection_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_access(facts.collections(spark, sf_dir), audit.WRITES)


_LIST = "coalesce(string_agg(distinct topic, ',' order by topic) filter (role = '{0}'), '') as {1}"


@query(f"with {EP} select module, {', '.join(_LIST.format(r, n) for n, r in (('served', 'serve'), ('called', 'call'), ('published', 'produce'), ('consumed', 'consume')))} from ep where module is not null group by module")
def module_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.module_lists(facts.endpoints(spark, sf_dir))


@query(f"""with {EP}, q as (select distinct concat(p_brand, '/', cast(p_size as varchar), '/') as query from part), n as (select distinct topic from ep),
hits as (select query, min(topic) as topic from q join n on instr(lower(topic), lower(query)) > 0 group by query having count(*) = 1 and query not in (select topic from n) union all select query, query from q where query in (select topic from n))
select distinct h.query, h.topic, coalesce(e.module, '') as service, e.id, e.role from hits h join ep e on e.topic = h.topic""")
def flow_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = facts.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), facts.text("p_size"), F.lit("/")).alias("query"))
    return catalog.flow_sites(asked, facts.endpoints(spark, sf_dir))


@query(f"""with {EP} select case when role = 'produce' then module else topic end as source, case when role = 'produce' then topic else module end as target, case when role = 'produce' then 'publishes' else 'consumes' end as relation,
  case when bool_or(topic_dynamic) then 'dynamic' when bool_or(source = 'manifest') then 'manifest' else 'code' end as evidence from ep where system = 'kafka' and module is not null group by 1, 2, 3""".replace("group by 1, 2, 3", "group by case when role = 'produce' then module else topic end, case when role = 'produce' then topic else module end, case when role = 'produce' then 'publishes' else 'consumes' end"))
def visual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.visual_edges(facts.endpoints(spark, sf_dir))


@query(f"{DEPENDENCY_EDGES} select 'nodes' as measure, count(*) as n from (select source from graph union select target from graph) x union all select 'links', count(*) from graph union all select concat('kind ', kind), count(*) from graph group by kind union all select concat('confidence ', confidence), count(*) from graph group by confidence")
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.graph_totals(dependency_graph(spark, sf_dir))


@query(f"with {EP} select case when topic_dynamic then null else module end as module, count(*) as n from ep group by 1")
def endpoints_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.endpoints(spark, sf_dir).withColumn("module", F.when(~F.col("topic_dynamic"), F.col("module")))
    return catalog.endpoints_by_module(e, keep_null=True)


@query(f"""with {EP}, {REST}, every as (select 'dynamic_kafka_topics' as category, id, module, topic, path, start_line from ep where system = 'kafka' and topic_dynamic
  union all select 'unknown_kafka_message_types', id, module, topic, path, start_line from ep where system = 'kafka' and message_type is null
  union all select 'unmatched_http_calls', id, module, topic, path, start_line from ep where system = 'rest' and role = 'call' and id not in (select call_id from rest)),
r as (select *, row_number() over (partition by category order by path, start_line, id) as k, count(*) over (partition by category) as c from every)
select category, id, module, topic, path, start_line, c > 20 as truncated from r where k <= 20""")
def unresolved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unresolved_samples(facts.endpoints(spark, sf_dir), rest_index(spark, sf_dir))


@query(f"with {EP}, {MOD} select distinct e.module as service from ep e left join modules m on m.identity = e.module where (m.identity is null or m.starts_application) and not contains(lower(e.module), 'test')")
def deployable_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.deployable(facts.endpoints(spark, sf_dir), facts.modules(spark, sf_dir))


@query(f"with {MOD}, q as (select identity as reference from modules union select name from modules union select p_brand from part) select reference, coalesce((select identity from modules where identity = reference), (select min(identity) from modules where name = reference having count(*) = 1)) as identity from q")
def module_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = facts.modules(spark, sf_dir)
    asked = m.select(F.col("identity").alias("reference")).union(m.select("name")).union(facts.table(spark, sf_dir, "part").select("p_brand"))
    return catalog.module_by_reference(asked, m)


@query(f"with {MOD}, w as (select case when c_custkey % 3 = 0 then concat('m', cast(c_custkey % 120 as varchar)) else c_mktsegment end as workload, c_custkey as replica from customer) select w.workload, w.replica, m.identity as module from w left join modules m on m.name = w.workload")
def workload_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.table(spark, sf_dir, "customer")
    w = c.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("m"), facts.text(F.col("c_custkey") % 120))).otherwise(F.col("c_mktsegment")).alias("workload"), F.col("c_custkey").alias("replica"))
    return catalog.workload_modules(w, facts.modules(spark, sf_dir)).select("workload", "replica", "module")


@query("select 'severity' as measure, severity as value, count(*) as n from fi group by severity union all (select 'rule', rule_id, count(*) as n from fi group by rule_id order by n desc, rule_id limit 10) union all select 'folder', split_part(path, '/', 1), count(*) from fi group by 2".replace("select 'severity'", f"with {FI} select 'severity'", 1).replace("group by 2", "group by split_part(path, '/', 1)"))
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.finding_summary(facts.findings(spark, sf_dir))


@query(f"with {FI} select id, rule_id, severity, path, start_line, cast(0 as double) as score from fi where severity in ('WARNING', 'ERROR') order by case severity when 'ERROR' then 3 when 'WARNING' then 2 else 1 end desc, path, start_line, id limit 40 offset 5")
def blank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_findings(facts.findings(spark, sf_dir), " ", limit=40, offset=5, least="WARNING").select("id", "rule_id", "severity", "path", "start_line", "score")


@query(f"with {EP} select count(*) as n from ep where path in (select concat('o/', cast(o_orderkey as varchar), '.java') from orders where o_orderstatus = 'P')")
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = facts.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o/"), facts.text("o_orderkey"), F.lit(".java")).alias("path"))
    return filters.rows_for_paths(facts.endpoints(spark, sf_dir), paths).agg(F.count("*").alias("n"))


CYCLE_SQL = f"""with recursive {EP}, {EFFECTIVE}, {KAFKA}, {REST}, {LINKS}, edge as (select distinct source, target from links), svc as (select distinct module as node from ep),
hop as (select distinct a.source, b.target from edge a join edge b on a.target = b.source and a.target not in (select node from svc) where a.source in (select node from svc) union select source, target from edge where source in (select node from svc) and target in (select node from svc)),
reach(source, target) as (select source, target from hop union select r.source, h.target from reach r join hop h on h.source = r.target),
comp as (select a.source as node, min(a.target) as least from (select a.source, a.target from reach a join reach b on a.source = b.target and a.target = b.source) a group by a.source),
topics as (select distinct t.target as node, c.least from edge t join comp c on c.node = t.source join edge u on u.source = t.target join comp d on d.node = u.target and d.least = c.least where t.target not in (select node from svc)),
every as (select node, least, 'service' as kind from comp union all select node, least, 'topic' from topics)
select min(node) as component, count(*) as nodes, count(*) filter (kind = 'service') as services, count(*) filter (kind = 'topic') as topics from every group by least having count(*) >= 3 and count(*) filter (kind = 'service') >= 2 and count(*) filter (kind = 'topic') >= 1"""


@query(CYCLE_SQL)
def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).select("source", "target").distinct()
    topics = facts.endpoints(spark, sf_dir).where("system = 'kafka'").select(F.col("topic").alias("node"), F.lit("topic").alias("kind"))
    services = facts.endpoints(spark, sf_dir).where("module is not null").select(F.col("module").alias("node"), F.lit("service").alias("kind"))
    return traversals.event_cycles(links, topics.union(services))


def _fact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of facts for each user: its events are nodes, each linked to the one before it; some manifests have faults."""
    e = facts.table(spark, sf_dir, "events")
    name = F.concat(F.lit("e"), facts.text("event_id"))
    kind = F.when(F.col("event_id") % 997 == 5, "planet").otherwise(F.get(F.array(F.lit("topic"), F.lit("api"), F.lit("microservice")), (F.col("event_id") % 3).cast("int")))
    status = F.when(F.col("event_id") % 1009 == 7, "ambiguous").otherwise("confirmed")
    node = F.struct(name.alias("id"), kind.alias("kind"), F.concat(F.lit("n"), facts.text(F.col("event_id") % 500)).alias("name"), status.alias("status"), F.array(F.struct(F.concat(F.lit("src/"), name).alias("path"), (F.col("event_id") % 90).cast("int").alias("start_line"))).alias("evidence"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))  # one user's events: a manifest is one document
    edge = F.transform(F.sequence(F.lit(2), F.size("nodes")), lambda k: F.struct(F.concat(F.lit("l"), F.element_at("nodes", k)["id"]).alias("id"), F.lit("calls").alias("kind"), F.element_at("nodes", k)["id"].alias("source"), F.element_at("nodes", k - 1)["id"].alias("target")))
    edges = F.when(F.size("nodes") > 1, edge)
    text = F.to_json(F.struct(F.lit("complete").alias("mode"), F.struct(F.concat(F.lit("user-"), facts.text("user_id")).alias("namespace")).alias("generated_by"), "nodes", edges.alias("edges")))
    return g.select(F.concat(F.lit("u/"), facts.text("user_id"), F.lit(".json")).alias("path"), text.alias("text"))


FACT_ROWS = """items as (select concat('u/', cast(user_id as varchar), '.json') as path, concat('user-', cast(user_id as varchar)) as namespace, concat('e', cast(event_id as varchar)) as id,
  case when event_id % 997 = 5 then 'planet' when event_id % 3 = 0 then 'topic' when event_id % 3 = 1 then 'api' else 'microservice' end as kind, concat('n', cast(event_id % 500 as varchar)) as name,
  case when event_id % 1009 = 7 then 'ambiguous' else 'confirmed' end as status, concat('src/e', cast(event_id as varchar)) as evidence_path, case when event_id % 90 >= 1 then cast(event_id % 90 as integer) end as evidence_line from events),
placed as (select *, row_number() over (partition by path order by id) - 1 as n, lag(id) over (partition by path order by id) as before_, lag(kind) over (partition by path order by id) as before_kind, lag(name) over (partition by path order by id) as before_name from items),
faults as (select path, n, 'unknown kind' as problem from placed where kind = 'planet' union all select path, n, 'no reason' from placed where status = 'ambiguous')"""


@query(f"with {FACT_ROWS} select path, 'node' as fact_type, cast(n as integer) as n, problem from faults")
def fact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.fact_violations(manifests.fact_items(_fact_files(spark, sf_dir)))


FACT_SQL = f"""with {FACT_ROWS}, good as (select * from placed where path not in (select path from faults)),
facts_ as (select concat(namespace, '::node::', id) as id, 'node' as fact_type, kind, name, cast(null as varchar) as source_kind, cast(null as varchar) as source_name, cast(null as varchar) as target_kind, cast(null as varchar) as target_name, cast(null as varchar) as relation, namespace, status, 'unknown' as confidence, evidence_path, evidence_line from good
  union all select concat(namespace, '::edge::l', id), 'edge', 'calls', null, kind, name, before_kind, before_name, 'calls', namespace, 'confirmed', 'unknown', null, null from good where before_ is not null)"""


def _manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.manifest_facts(manifests.fact_items(_fact_files(spark, sf_dir))).drop("note", "complete")


@query(f"{FACT_SQL} select * from facts_")
def manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_facts(spark, sf_dir)


@query(f"{FACT_SQL} select namespace, fact_type, count(*) as n from facts_ group by all")
def facts_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_facts(spark, sf_dir).groupBy("namespace", "fact_type").agg(F.count("*").alias("n"))


@query(f"{FACT_SQL}, s as (select distinct concat('n', cast(s_suppkey as varchar)) as service from supplier) select distinct id, service from (select id, unnest([name, source_name, target_name]) as service from facts_) x where service in (select service from s)")
def fact_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = facts.table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), facts.text("s_suppkey")).alias("service"))
    return manifests.fact_services(_manifest_facts(spark, sf_dir), services)


@query(f"{FACT_SQL} select id, fact_type from facts_ where id not in (select concat('user-', cast(user_id as varchar), '::node::e', cast(event_id as varchar)) from events where event_type = 'click')")
def fact_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.table(spark, sf_dir, "events").where("event_type = 'click'")
    gone = e.select(F.concat(F.lit("user-"), facts.text("user_id"), F.lit("::node::e"), facts.text("event_id")).alias("id"))
    return deltas.delete_keys(_manifest_facts(spark, sf_dir), gone).select("id", "fact_type")


@query(f"with {EP}, f as (select concat(module, ':', id) as id, case when role in ('serve', 'call') then module else 'shared' end as module, topic from ep) select id, module, topic from f qualify row_number() over (partition by id order by module nulls first, topic nulls first) = 1")
def federated_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.endpoints(spark, sf_dir)
    rows = e.select("id", F.col("module").alias("service"), F.when(F.col("system") == "rest", "local").otherwise("shared").alias("module"), "topic")
    services = e.select(F.col("module").alias("service")).distinct().withColumn("local", F.lit("local"))
    return catalog.federated(rows, services).select("id", "module", "topic")


@query(f"with {EP}, f as (select concat(module, ':', role, id) as id, case when system = 'kafka' then module else 'me' end as source_name, case when role in ('consume', 'serve') then module else topic end as target_name from ep) select id, source_name, target_name from f qualify row_number() over (partition by id order by source_name nulls first, target_name nulls first) = 1")
def federated_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.endpoints(spark, sf_dir)
    kind = F.when(F.col("system") == "kafka", "microservice").otherwise("module")
    back = F.col("role").isin("consume", "serve")
    rows = e.select(F.concat("role", "id").alias("id"), F.col("module").alias("service"), kind.alias("source_kind"), F.lit("me").alias("source_name"), F.when(back, "microservice").otherwise("topic").alias("target_kind"), F.when(back, "me").otherwise(F.col("topic")).alias("target_name"))
    services = e.select(F.col("module").alias("service")).distinct().withColumn("local", F.lit("me"))
    return catalog.federated(rows, services).select("id", "source_name", "target_name")


@query(f"with {MOD} select identity as service, 'not indexed: dependencies are partial' as warning from modules where starts_application and identity not in (select concat('svc-', cast(n_nationkey as varchar)) from nation)")
def federation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = facts.table(spark, sf_dir, "nation").select(F.concat(F.lit("svc-"), facts.text("n_nationkey")).alias("service"))
    return catalog.federation_warnings(catalog.workspace_services(facts.modules(spark, sf_dir)), indexed)


@query("""with f as (select concat(source, '/', lang, '/m', cast(doc_id % 9 as varchar), '/application', case doc_id % 3 when 0 then '' when 1 then '-prod' else '-dev' end, '.properties') as path from documents union select concat(source, '/application.properties') from documents),
files as (select distinct path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, case when path like '%-prod.properties' then 1 when path like '%-dev.properties' then null else 0 end as k from f),
s as (select distinct concat(source, '/', lang, '/m', cast(doc_id % 9 as varchar), '/src/A.java') as spot from documents),
near as (select spot, path, length(dir) as l, k from s join files on starts_with(spot, concat(dir, '/')) where k is not null)
select spot, path, cast(row_number() over (partition by spot order by l desc, k, path) as integer) as rank from near""")
def property_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents")
    folder = F.concat("source", F.lit("/"), "lang", F.lit("/m"), facts.text(F.col("doc_id") % 9))
    ends = F.get(F.array(F.lit(""), F.lit("-prod"), F.lit("-dev")), (F.col("doc_id") % 3).cast("int"))
    files = d.select(F.concat(folder, F.lit("/application"), ends, F.lit(".properties")).alias("path")).union(d.select(F.concat("source", F.lit("/application.properties")))).distinct()
    return manifests.property_rank(files, d.select(F.concat(folder, F.lit("/src/A.java")).alias("spot")).distinct(), ["prod"])


@query("""with f as (select distinct concat(source, '/', lang, '/m', cast(doc_id % 9 as varchar), '/pom.xml') as path from documents where lang <> 'en' union select concat(source, '/pom.xml') from documents where lang = 'en'),
d as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as folder from f) select folder from d where not exists (select 1 from d u where starts_with(d.folder, concat(u.folder, '/')))""")
def nested_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents")
    deep = d.where("lang <> 'en'").select(F.concat("source", F.lit("/"), "lang", F.lit("/m"), facts.text(F.col("doc_id") % 9), F.lit("/pom.xml")).alias("path"))
    return manifests.nested_roots(deep.union(d.where("lang = 'en'").select(F.concat("source", F.lit("/pom.xml")))))


@query("""with f as (select concat(source, '/', case doc_id % 5 when 0 then 'order-test' when 1 then 'mocks' else 'core' end, '/', cast(doc_id as varchar), '.java') as path from documents)
select path from f where not regexp_matches(path, '/(order-test|mocks)/')""")
def files_of_kept_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents")
    folder = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 5 == 0, "order-test").when(F.col("doc_id") % 5 == 1, "mocks").otherwise("core"))
    return manifests.without_excluded(d.select(F.concat(folder, F.lit("/"), facts.text("doc_id"), F.lit(".java")).alias("path")), d.select(folder.alias("path")).distinct())


@query("""with d as (select distinct concat(p_brand, '/', p_type, '/api', cast(p_partkey % 40 as varchar), '.yaml') as path, p_brand, p_type, p_partkey % 40 as k from part)
select path, min(case when k % 4 = 0 then concat('built-', cast(k as varchar)) when k % 4 < 3 then concat(p_brand, '/', p_type) else concat(p_brand, '/', p_type) end) as module from d group by path""")
def contract_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 40)
    folder = F.concat("p_brand", F.lit("/"), "p_type")
    docs = p.select(F.concat(folder, F.lit("/api"), facts.text("k"), F.lit(".yaml")).alias("path"), "k").distinct()
    named = docs.where("k % 4 = 0").select("path", F.concat(F.lit("built-"), facts.text("k")).alias("module"))
    around = p.select(folder.alias("folder"), folder.alias("module")).union(p.select("p_brand", "p_brand")).distinct()
    return manifests.contract_owners(docs, named, around)


def _config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested configuration file of each supplier, with a list and a remark that count for nothing."""
    s = facts.table(spark, sf_dir, "supplier")
    n = facts.text("s_suppkey")
    body = F.concat(F.lit("# supplier\nserver:\n  port: 80"), n, F.lit("\n  hosts:\n    - a: 1\n    - b\nspring:\n  kafka:\n    group: 'g"), facts.text("s_nationkey"), F.lit("'\n  name: "), "s_name", F.lit("\nflag: true # on\n"))
    return s.select(F.concat(F.lit("c/"), n, F.lit(".yml")).alias("path"), body.alias("text"))


PAIRS_SQL = """pairs as (select concat('c/', cast(s_suppkey as varchar), '.yml') as path, unnest(['server.port', 'spring.kafka.group', 'spring.name', 'flag']) as key,
  unnest([concat('80', cast(s_suppkey as varchar)), concat('g', cast(s_nationkey as varchar)), s_name, 'true']) as value from supplier)"""


@query(f"with {PAIRS_SQL} select path, key, value from pairs")
def nested_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.flattened(_config_files(spark, sf_dir))


@query(f"""with {PAIRS_SQL}, up as (select path, array_to_string(string_split(key, '.')[1:d], '.') as key, d as depth, case when d = len(string_split(key, '.')) then value end as value from pairs, lateral (select unnest(range(1, len(string_split(key, '.')) + 1)) as d) x)
select key, case when depth > 1 then regexp_replace(key, '[.][^.]*$', '') end as parent, cast(depth as integer) as depth, count(distinct path) as files, min(value) as example from up group by key, depth""")
def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.config_keys(manifests.flattened(_config_files(spark, sf_dir)))


@query("""with c as (select concat(cast(conv_id as varchar), ':', cast(turn as varchar)) as id, string_split(text, chr(10)) as l, cast(1 + turn % 3 as integer) as a, cast(1 + turn % 3 + conv_id % 2 as integer) as b from conversations where text is not null)
select id, case when a <= least(b, len(l)) then array_to_string(l[a:least(b, len(l))], chr(10)) end as snippet from c""")
def endpoint_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.table(spark, sf_dir, "conversations").where("text is not null").withColumn("path", F.concat(facts.text("conv_id"), F.lit(":"), facts.text("turn")))
    start = (1 + F.col("turn") % 3).cast("int")
    return manifests.snippets(c.select("path", "text"), c.select(F.col("path").alias("id"), "path", start.alias("start_line"), (start + F.col("conv_id") % 2).cast("int").alias("end_line")))


@query("""with recursive ty as (select distinct p_type as name, p_brand as package, p_size % 7 as k from part), uses as (select distinct a.name as source, b.name as target from ty a join ty b on b.k = (a.k + 1) % 7 and a.package = b.package where a.name <> b.name),
roots as (select distinct 'dto' as kind, name as root from ty), reach(root, node) as (select root, root from roots union select r.root, u.target from reach r join uses u on u.source = r.node) select root, node from reach""")
def dto_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("package"), (F.col("p_size") % 7).alias("k")).distinct()
    uses = p.alias("a").join(p.alias("b"), (F.col("a.package") == F.col("b.package")) & ((F.col("a.k") + 1) % 7 == F.col("b.k"))).where("a.name <> b.name").select(F.col("a.name").alias("source"), F.col("b.name").alias("target")).distinct()
    return resolution.closures(p.select(F.col("name").alias("root"), F.col("name").alias("node")), uses)


@query(f"with {EP} select id, role, system, topic, topic_dynamic, module, concat(path, ':', cast(start_line as varchar), '-', cast(end_line as varchar)) as place from ep")
def endpoint_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.endpoint_projection(facts.endpoints(spark, sf_dir))


@query(f"{DEPENDENCY_EDGES} select target as api, count(distinct source) as callers, bool_or(confidence = 'medium') as dynamic from graph where kind = 'calls_external' group by target")
def external_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dependency_graph(spark, sf_dir).where("kind = 'calls_external'")
    return g.groupBy(F.col("target").alias("api")).agg(F.count_distinct("source").alias("callers"), F.max(F.col("confidence") == "medium").alias("dynamic"))


@query(f"with {EP}, {REST} select source, target, count(distinct serve) as routes, count(distinct call_id) as calls from rest group by all")
def service_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rest_index(spark, sf_dir).groupBy("source", "target").agg(F.count_distinct("serve").alias("routes"), F.count_distinct("call_id").alias("calls"))


@query("""with w as (select concat('k', cast(p_partkey as varchar)) as id, concat('app.', lower(p_type), '.', cast(p_size as varchar)) as key, p_brand as "default" from part),
f as (select p_size % 3 as rank, concat('app.', lower(p_type), '.', cast(p_size as varchar)) as key, max(p_name) as value from part where p_partkey % 2 = 0 group by 1, 2),
one as (select key, value from f qualify row_number() over (partition by key order by rank) = 1)
select w.id, coalesce(one.value, w."default") as value from w left join one on one.key = w.key""")
def resolved_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    key = F.concat(F.lit("app."), F.lower("p_type"), F.lit("."), facts.text("p_size"))
    wanted = p.select(F.concat(F.lit("k"), facts.text("p_partkey")).alias("id"), key.alias("key"), F.col("p_brand").alias("default"))
    found = p.where("p_partkey % 2 = 0").groupBy((F.col("p_size") % 3).alias("rank"), key.alias("key")).agg(F.max("p_name").alias("value"))
    return manifests.resolve_property(wanted, found)


@query(f"with {MOD} select identity as service from modules where starts_application and identity not in (select concat('svc-', cast(user_id % 100 as varchar)) from events where event_type = 'error' and value > 120)")
def missing_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = facts.modules(spark, sf_dir).where("starts_application").select(F.col("identity").alias("service"))
    e = facts.table(spark, sf_dir, "events").where("event_type = 'error' and value > 120")
    return resolution.missing_services(declared, e.select(F.concat(F.lit("svc-"), facts.text(F.col("user_id") % 100)).alias("service")).distinct())
