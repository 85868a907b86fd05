"""Routes, names, globs and quantities as column expressions; all of it stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def method(route: Column) -> Column:
    return F.substring_index(route, " ", 1)


def segments(route: Column) -> Column:
    """Non-empty parts of a route's path, without its query string."""
    path = F.expr("substr(x, instr(x, ' ') + 1)") if isinstance(route, str) else F.regexp_replace(route, r"^[^ ]* ", "")
    return F.filter(F.split(F.substring_index(path, "?", 1), "/"), lambda s: s != "")


def same_segment(a: Column, b: Column) -> Column:
    return (a == b) | a.rlike(r"^\{.*\}$") | b.rlike(r"^\{.*\}$")


def wild(a: Column, b: Column) -> Column:
    """``a`` ends in ** and ``b`` is strictly longer than what stands before it, and agrees with it."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return (F.try_element_at(a, F.lit(-1)) == "**") & (F.size(b) > n) & F.forall(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), same_segment), lambda z: z)


def routes_match(call_method: Column, call: Column, serve_method: Column, serve: Column) -> Column:
    """Whether a call's segments fit a served route's. A call of the root path fits nothing."""
    verbs = (call_method == serve_method) | (call_method == "ANY") | (serve_method == "ANY")
    paths = wild(call, serve) | wild(serve, call) | ((F.size(call) == F.size(serve)) & F.forall(F.zip_with(call, serve, same_segment), lambda z: z))
    known = F.try_element_at(call, F.lit(1)) != "<dynamic>"
    return F.coalesce(verbs & known & (F.size(call) > 0) & F.coalesce(paths, F.lit(False)), F.lit(False))


def alias(name: Column) -> Column:
    """A service name for matching: lower case, trimmed, without a last dot."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\.$", "")


def _found(snippet: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(snippet, pattern, 1), F.lit(""))


def domain(snippet: Column) -> Column:
    """The domain of a configured client, from its marker; null if none."""
    return _found(snippet, r"domain=([A-Za-z0-9._-]+)")


def external(snippet: Column) -> Column:
    """The service outside that a call is marked with; null if none."""
    return _found(snippet, r"external=([A-Za-z0-9._-]+)")


def kebab(name: Column) -> Column:
    """A camel-case name in lower case, its parts joined by hyphens."""
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "-"))


def target_hint(snippet: Column, *, getters: bool = False) -> Column:
    """The service that a call names: host of an http(s) or lb:// address, else a domain marker; null if none.

    With ``getters``, a getter of a service's address (``.getPaymentServiceUrl(``) comes first.
    """
    getter = _found(snippet, r"\.get([A-Z][A-Za-z0-9]*)ServiceUrl\(")
    named = F.concat(kebab(getter), F.lit("-service"))
    hints = [_found(snippet, r"https?://([A-Za-z0-9._-]+)"), _found(snippet, r"lb://([A-Za-z0-9._-]+)"), domain(snippet)]
    return F.coalesce(*([named] if getters else []), *hints)


def glob_pattern(glob: str, negation: str = "^") -> str:
    """A glob as an anchored regular expression: * crosses /, ? is one character, sets negate by ``negation``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append(f"[^{body[1:]}]" if body[0] == negation else f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def screaming_snake(name: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def cpu_millicores(q: Column) -> Column:
    """250m is 250, 0.5 is 500; null if it isn't a quantity."""
    return F.when(q.endswith("m"), F.regexp_extract(q, r"^([0-9]+)m$", 1).try_cast("long")).otherwise((q.try_cast("double") * 1000).cast("long"))


def memory_bytes(q: Column) -> Column:
    """Binary (Ki, Mi, Gi, Ti) and decimal (K, M, G, T) units; null if it isn't a quantity."""
    number, unit = F.regexp_extract(q, r"^([0-9.]+)", 1).try_cast("double"), F.regexp_extract(q, r"([A-Za-z]*)$", 1)
    scale = F.lit(None).cast("double")
    for k, u in enumerate("KMGT"):
        scale = F.when(unit == f"{u}i", F.lit(1024.0 ** (k + 1))).when(unit == u, F.lit(1000.0 ** (k + 1))).otherwise(scale)
    return (number * F.when(unit == "", F.lit(1.0)).otherwise(scale)).cast("long")


def is_test_source(path: Column) -> Column:
    return path.rlike(r"(^|/)src/([^/]*Test|test)(/|$)")


def ancestors(path: Column) -> Column:
    """The folders above a path, nearest first, and '.' at last."""
    parts = F.split(path, "/")
    return F.concat(F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/"))))
