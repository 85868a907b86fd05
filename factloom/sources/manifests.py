"""Declared topics, flow graphs, properties and workloads from text and JSON, by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import ancestors, cpu_millicores, glob_pattern, is_test_source, memory_bytes


def scan_files(spark, folder: str, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, sha256, content of files below a folder; test sources and .git are left out, then excluded globs, then all but included ones.

    Spark's file source gives no row for an empty file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return keep_paths(files.select("path", F.sha2("content", 256).alias("sha256"), "content"), include=include, exclude=exclude)


def keep_paths(files: DataFrame, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    path = F.col("path")
    out = files.where(~is_test_source(path) & ~path.rlike(r"(^|/)\.git(/|$)"))
    for g in exclude or []:
        out = out.where(~path.rlike(glob_pattern(g, "!")))
    kept = F.lit(False)
    for g in include or ["**/*"]:
        kept = kept | (F.lit(True) if g == "**/*" else path.rlike(glob_pattern(g, "!")))
    return out.where(kept)


def topic_tables(files: DataFrame) -> DataFrame:
    """path, line, module, role, topic of Markdown manifests (path, text).

    A heading of level three sets the module, a bold word the role, rows of a table give topics:
    the second cell (the physical name) if it has one, else the first.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "own"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.nullif(F.trim(F.regexp_extract("own", r"^###\s+`?([^`]+?)`?\s*$", 1)), F.lit(""))
    bold = F.lower(F.regexp_extract("own", r"(?i)^\*\*\s*(producer|consumer)s?\s*\*\*", 1))
    role = F.when(bold == "producer", "produce").when(bold == "consumer", "consume")
    lines = lines.withColumns({"module": F.last_value(heading, True).over(w), "role": F.last_value(role, True).over(w)})
    cells = F.transform(F.filter(F.split("own", r"\|"), lambda c: F.trim(c) != ""), lambda c: F.trim(F.translate(c, "`", "")))
    rows = lines.where(F.col("own").rlike(r"^\s*\|")).withColumn("cells", cells).where(F.size("cells") > 0)
    rows = rows.where(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")) & (F.lower(F.get("cells", F.lit(0))) != "topic"))
    topic = F.coalesce(F.nullif(F.get("cells", F.lit(1)), F.lit("-")), F.get("cells", F.lit(0)))
    return rows.where("module is not null and role is not null").select("path", "line", "module", "role", topic.alias("topic"))


FLOW = "topics map<string,string>, producers map<string,array<string>>, consumers map<string,array<string>>"


def flow_graphs(files: DataFrame) -> DataFrame:
    """path, module, role, topic of JSON flow graphs (path, text); a topic without a physical name keeps its own."""
    g = files.select("path", F.from_json("text", FLOW).alias("g"))
    side = lambda column, role: g.select("path", F.explode(f"g.{column}").alias("module", "names"), "g.topics").select("path", "module", F.lit(role).alias("role"), F.explode("names").alias("name"), "topics")
    both = side("producers", "produce").union(side("consumers", "consume"))
    return both.select("path", "module", "role", F.coalesce(F.try_element_at("topics", "name"), "name").alias("topic"))


def properties(files: DataFrame) -> DataFrame:
    """path, key, value of property files (path, text): cut at the first = or :, lines with # or ! are remarks; the last of a key counts."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "own")).where(F.trim("own").rlike("^[^#!]"))
    pairs = lines.select("path", "line", F.trim(F.regexp_extract("own", "^([^=:]*)[=:]", 1)).alias("key"), F.trim(F.regexp_extract("own", "^[^=:]*[=:](.*)$", 1)).alias("value")).where("key <> ''")
    return pairs.groupBy("path", "key").agg(F.max_by("value", "line").alias("value"))


def resolve_property(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """id, value: the value of the first file (lowest rank) that has the key, else the default. ``found``: rank, key, value."""
    first = found.groupBy("key").agg(F.min_by("value", "rank").alias("_v"))
    return wanted.join(first, "key", "left").select("id", F.coalesce("_v", "default").alias("value"))


def openapi_routes(files: DataFrame) -> DataFrame:
    """path, route: METHOD /path of OpenAPI documents (path, text), in YAML where a path ends in .yml or .yaml, else in JSON."""
    by_yaml = F.lower("path").rlike(r"\.ya?ml$")
    files = files.where(~by_yaml).select("path", "text").union(yaml_as_json(files.where(by_yaml)))
    d = files.select("path", F.from_json("text", "paths map<string,map<string,string>>").alias("d"))
    ways = d.select("path", F.explode("d.paths").alias("url", "methods")).select("path", "url", F.explode("methods").alias("method", "_"))
    return ways.where(F.lower("method").isin("get", "put", "post", "delete", "patch", "head", "options", "trace")).select("path", F.concat(F.upper("method"), F.lit(" "), "url").alias("route"))


def workload_sizes(containers: DataFrame) -> DataFrame:
    """workload and its summed requests and limits; missing ones are skipped, all missing gives null. Init containers don't count."""
    run = containers.where(~F.col("init"))
    return run.groupBy("workload").agg(F.sum(cpu_millicores(F.col("cpu_request"))).alias("cpu_request_millicores"), F.sum(memory_bytes(F.col("memory_request"))).alias("memory_request_bytes"), F.sum(cpu_millicores(F.col("cpu_limit"))).alias("cpu_limit_millicores"), F.sum(memory_bytes(F.col("memory_limit"))).alias("memory_limit_bytes"))


# What facts of a manifest may say of themselves.
NODE_KINDS = ["microservice", "module", "topic", "api", "collection", "dto", "external", "database", "queue", "class"]
STATUSES = ["confirmed", "inferred", "ambiguous", "unresolved"]
CONFIDENCES = ["high", "medium", "low", "unknown"]


def _manifests(files: DataFrame) -> DataFrame:
    item = "struct<id: string, kind: string, name: string, source: string, target: string, relation: string, status: string, confidence: string, reason: string, technology: string, evidence: array<struct<path: string, start_line: int>>>"
    schema = f"mode string, generated_by struct<namespace: string, pass: string, source_revision: string>, nodes array<{item}>, edges array<{item}>"
    return files.select("path", F.from_json("text", schema).alias("m"))


def fact_items(files: DataFrame) -> DataFrame:
    """path, namespace, pass, source_revision, complete, fact_type, n (its place), and the fields of each node and edge of fact manifests in JSON (path, text)."""
    m = _manifests(files)
    own = [F.col("path"), F.coalesce("m.generated_by.namespace", F.lit("default")).alias("namespace"), F.col("m.generated_by.pass").alias("pass"), F.col("m.generated_by.source_revision").alias("source_revision"), (F.coalesce("m.mode", F.lit("partial")) == "complete").alias("complete")]
    side = lambda column, kind: m.select(*own, F.lit(kind).alias("fact_type"), F.posexplode(f"m.{column}").alias("n", "x"))
    every = side("nodes", "node").union(side("edges", "edge"))
    first = F.get("x.evidence", F.lit(0))
    line = F.when(first["start_line"] >= 1, first["start_line"])
    fields = ["id", "kind", "name", "source", "target", "relation", "reason", "technology"]
    return every.select("path", "namespace", "pass", "source_revision", "complete", "fact_type", "n", *(F.col(f"x.{c}").alias(c) for c in fields), F.coalesce("x.status", F.lit("confirmed")).alias("status"), F.coalesce("x.confidence", F.lit("unknown")).alias("confidence"), first["path"].alias("evidence_path"), line.alias("evidence_line"))


def fact_violations(items: DataFrame) -> DataFrame:
    """path, fact_type, n, problem: what is wrong with the items of manifests; a manifest with any problem is not imported."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    edge, doubt = F.col("fact_type") == "edge", F.col("status").isin("ambiguous", "unresolved")
    checks = [
        (blank("id"), "no id"),
        (blank("kind"), "no kind"),
        (~edge & blank("name"), "no name"),
        (~edge & ~blank("kind") & ~F.col("kind").isin(NODE_KINDS), "unknown kind"),
        (edge & (blank("source") | blank("target")), "no end"),
        (~F.col("status").isin(STATUSES) | ~F.col("confidence").isin(CONFIDENCES), "status or confidence"),
        (doubt & blank("reason"), "no reason"),
    ]
    own = items.select("path", "fact_type", "n", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)))).alias("problem"))
    twice = items.where("id is not null").groupBy("path", "id").agg(F.count("*").alias("_k")).where("_k > 1").select("path", "id")
    repeated = items.join(twice, ["path", "id"]).select("path", "fact_type", "n", F.lit("repeated id").alias("problem"))
    ends = items.where(edge).select("path", "fact_type", "n", F.explode(F.array("source", "target")).alias("id")).where("id is not null")
    unknown = ends.join(items.where(~edge).select("path", "id").distinct(), ["path", "id"], "left_anti").select("path", "fact_type", "n", F.lit("unknown end").alias("problem"))
    return own.union(repeated).union(unknown).distinct()


def manifest_facts(items: DataFrame) -> DataFrame:
    """Facts of the manifests without a problem: id in its namespace, fact_type, kind, name, ends by kind and name, relation, namespace, status, confidence, evidence and note."""
    good = items.join(fact_violations(items).select("path").distinct(), "path", "left_anti")
    nodes = good.where("fact_type = 'node'").select("path", "id", F.col("kind").alias("k"), F.col("name").alias("n_"))
    s = nodes.select("path", F.col("id").alias("source"), F.col("k").alias("source_kind"), F.col("n_").alias("source_name"))
    t = nodes.select("path", F.col("id").alias("target"), F.col("k").alias("target_kind"), F.col("n_").alias("target_name"))
    out = good.join(s, ["path", "source"], "left").join(t, ["path", "target"], "left")
    edge = F.col("fact_type") == "edge"
    key = F.concat("namespace", F.lit("::"), "fact_type", F.lit("::"), "id")
    relation = F.when(edge, F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.col("kind")))
    return out.select(key.alias("id"), "fact_type", "kind", F.when(~edge, F.col("name")).alias("name"), "source_kind", "source_name", "target_kind", "target_name", relation.alias("relation"), "namespace", "status", "confidence", "evidence_path", "evidence_line", F.col("reason").alias("note"), "complete")


# manifests' edges between services, the roles of their ends and the kind of edge that they are.
PROJECTED = {"http": ("call", "serve", "rest"), "kafka": ("produce", "consume", "kafka")}


def projected_facts(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(endpoints, edges, issues) that the edges between services of manifests stand for, beside what was indexed.

    An edge of kind http or kafka with an id, a relation's topic and two service ends gives a call or
    producer at its source, a route or consumer at its target, and the edge between them. Ambiguous
    and unresolved ones give an issue with their reason instead, edges of other kinds nothing.
    """
    good = manifest_facts(items).where("fact_type = 'edge'").where(F.col("kind").isin(*PROJECTED))
    services = F.col("source_kind").isin("microservice", "external") & F.col("target_kind").isin("microservice", "external")
    doubt = F.col("status").isin("ambiguous", "unresolved")
    issues = good.where(doubt).select("id", F.coalesce("note", F.lit("unresolved relation")).alias("reason"))
    sure = good.where(services & ~doubt)
    pick = lambda k: F.create_map(*(F.lit(x) for kind, own in PROJECTED.items() for x in (kind, own[k])))[F.col("kind")]
    site = lambda end, k: F.struct(F.concat("id", F.lit(f"#{end}")).alias("id"), pick(k).alias("role"), F.col(f"{end}_name").alias("module"))
    ends = sure.select(F.explode(F.array(site("source", 0), site("target", 1))).alias("x"), pick(2).alias("system"), F.col("relation").alias("topic"), "evidence_path", "evidence_line", "confidence")
    endpoints = ends.select("x.id", "x.role", "system", "topic", "x.module", F.lit("manifest").alias("source"), F.col("evidence_path").alias("path"), F.col("evidence_line").alias("start_line"), "confidence")
    edges = sure.select(pick(2).alias("kind"), F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.concat("id", F.lit("#source")).alias("source_id"), F.concat("id", F.lit("#target")).alias("target_id"))
    return endpoints, edges, issues


def fact_services(facts: DataFrame, services: DataFrame) -> DataFrame:
    """id, service: the services that a fact names as itself or as an end. ``services``: service."""
    names = facts.select("id", F.explode(F.array_distinct(F.array_compact(F.array("name", "source_name", "target_name")))).alias("service"))
    return names.join(services.select("service").distinct(), "service", "left_semi").select("id", "service")


def property_rank(files: DataFrame, spots: DataFrame, profiles: list[str]) -> DataFrame:
    """spot, path, rank of the property files that a place reads: nearer folders first, in a folder the base file before profiles in their order.

    ``files`` has path (``folder/application[-profile].properties``), ``spots`` spot, a path.
    """
    name = F.regexp_extract("path", r"application(?:-([A-Za-z0-9_]+))?\.(?:properties|ya?ml)$", 1)
    own = files.where(F.col("path").rlike(r"(^|/)application(-[A-Za-z0-9_]+)?\.(properties|ya?ml)$")).select("path", name.alias("profile"), F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")).alias("dir"))
    order = F.when(F.col("profile") == "", 0)
    for k, p in enumerate(profiles):
        order = order.when(F.col("profile") == p, k + 1)
    up = spots.select("spot", F.posexplode(ancestors(F.col("spot"))).alias("up", "dir"))
    near = up.join(own.withColumn("order", order).where("order is not null"), "dir")
    rank = F.row_number().over(Window.partitionBy("spot").orderBy("up", "order", "path"))
    return near.select("spot", "path", rank.alias("rank"))


def enclosing(files: DataFrame, folders: DataFrame) -> DataFrame:
    """path, folder: the deepest of the folders (folder) that a file is in; files in none are left out."""
    up = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("up", "folder"))
    return up.join(folders.select("folder").distinct(), "folder").groupBy("path").agg(F.min_by("folder", "up").alias("folder"))


def nested_roots(descriptors: DataFrame, *, most_depth: int = 5) -> DataFrame:
    """folder: the outermost folders with a build descriptor (path), at most ``most_depth`` deep, if the root has none."""
    parts = F.split("path", "/")
    own = descriptors.select(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "/")).otherwise(F.lit(".")).alias("folder")).distinct()
    top = own.where("folder = '.'").limit(1).select(F.lit(True).alias("_top"))
    deep = own.where((F.col("folder") != ".") & (F.size(F.split("folder", "/")) <= most_depth))
    above = deep.select("folder", F.explode(ancestors(F.col("folder"))).alias("up")).where("up <> '.'")
    inner = above.join(deep.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return deep.join(inner, "folder", "left_anti").join(top, F.lit(True), "left_anti")


# Parts of names of modules that are left out.
EXCLUDED_MODULES = "mock|test|archteype"


def without_excluded(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files outside modules (path) whose folder has a name that is left out."""
    bad = modules.where(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(EXCLUDED_MODULES)).select(F.col("path").alias("_m")).distinct()
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("_m")).join(bad, "_m", "left_semi").select("path").distinct()
    return files.join(up, "path", "left_anti")


def contract_owners(documents: DataFrame, configured: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module: of each contract document the module whose build names it, else the deepest module folder around it.

    ``documents`` has path, ``configured`` path and module, ``modules`` folder and module.
    """
    named = configured.groupBy("path").agg(F.min("module").alias("_named"))
    around = enclosing(documents.select("path"), modules.select("folder")).join(modules.groupBy("folder").agg(F.min("module").alias("_around")), "folder").select("path", "_around")
    return documents.select("path").distinct().join(named, "path", "left").join(around, "path", "left").select("path", F.coalesce("_named", "_around").alias("module"))


def _documents(text: str | None) -> list:
    """The documents of a YAML (or JSON) text with all scalars as they are written; none where it can't be read."""
    try:
        import yaml
    except ImportError as problem:
        raise RuntimeError("reading YAML needs the yaml library on the executors") from problem
    try:
        return [d for d in yaml.load_all(text or "", Loader=yaml.BaseLoader) if d is not None]
    except yaml.YAMLError:
        return []


def _flat(found: dict[str, str], node, name: str = "") -> dict[str, str]:
    """Dotted keys and scalar values of a nested mapping; lists are left out, an empty value is none."""
    if isinstance(node, dict):
        for key, value in node.items():
            if isinstance(key, str):
                _flat(found, value, f"{name}.{key}" if name else key)
    elif isinstance(node, str) and name and node:
        found[name] = node
    return found


def flattened(files: DataFrame) -> DataFrame:
    """path, key, value of nested configuration files (path, text; YAML or JSON) by dotted keys.

    Scalars only, as they are written (quotes and remarks taken off, flow maps and block texts read); the last of a key
    counts, over all documents of a file. A file that can't be read, or a null one, gives no row.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                found: dict[str, str] = {}
                for document in _documents(text):
                    _flat(found, document)
                rows += [(path, k, v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "key", "value"])

    return files.select("path", "text").mapInArrow(run, "path string, key string, value string")


#: A task remembers so many texts it has read last, and reads equal ones once.
KNOWN_TEXTS = 1024


def yaml_as_json(files: DataFrame) -> DataFrame:
    """path, text: the first document of each YAML file (path, text) as JSON, all scalars as texts; null where it can't be read."""

    def run(batches):
        import json
        from functools import lru_cache

        import pyarrow as pa

        @lru_cache(maxsize=KNOWN_TEXTS)
        def shown(text):
            found = _documents(text)
            return json.dumps(found[0]) if found else None

        for batch in batches:
            texts = [shown(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "text").mapInArrow(run, "path string, text string")


def config_keys(pairs: DataFrame) -> DataFrame:
    """key, parent, depth, files, example: every dotted key and the keys above it, in how many files they are, and an example value of leaves."""
    parts = F.split("key", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("key"), n.alias("depth"), (n == F.size(parts)).alias("leaf")))
    rows = pairs.select("path", "value", F.explode(up).alias("x")).select("path", "x.key", "x.depth", F.when(F.col("x.leaf"), F.col("value")).alias("value"))
    out = rows.groupBy("key", "depth").agg(F.count_distinct("path").alias("files"), F.min("value").alias("example"))
    return out.select("key", F.when(F.col("depth") > 1, F.regexp_replace("key", r"\.[^.]*$", "")).alias("parent"), "depth", "files", "example")


def snippets(files: DataFrame, spots: DataFrame) -> DataFrame:
    """id, snippet: the lines ``start_line`` to ``end_line`` of each spot (id, path, start_line, end_line)."""
    near = spots.join(files.select("path", "text"), "path").withColumn("_l", F.split("text", "\n"))
    low = F.greatest(F.col("start_line"), F.lit(1))
    high = F.least(F.coalesce("end_line", "start_line"), F.size("_l"))
    return near.select("id", F.when(low <= high, F.array_join(F.slice("_l", low, high - low + 1), "\n")).alias("snippet"))
