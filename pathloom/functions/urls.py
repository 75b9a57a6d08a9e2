"""Parsing, shapes and normal forms of URLs and URNs.

``parse_urls`` adds one struct, ``with_types`` and ``with_shapes`` the typed
columns beside it. Each step is a projection of its own, so that Catalyst
evaluates what several columns use once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from .values import Activation, canonical_form, classify, lower_each, param_name_hint, placeholder, registrable_domain, singularize

STRIP = " \t\r\n\x0b\x0c\x00"
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+\-.]*):"
_TAIL = r"([/?#](?d:.*))?\z"
_HOST = r"^([^/?#: \t\r\n\x0B\f]+\.[^/?#: \t\r\n\x0B\f]+|localhost)(?::([0-9]+))?"
HOSTISH = _HOST + _TAIL
_ANY = r"^([^/?#]+?)(?::([0-9]+))?"
AUTHORITY = _ANY + _TAIL
#: What goes before the path, and the rules for its host and port, which read no more than this.
_BEFORE, _HOSTS = r"^([^/?#]*)" + _TAIL, (_HOST + r"\z", _ANY + r"\z")
_PARAM = "array<struct<name:string,value:string>>"


def fenced(c: Column) -> Column:
    """The column, behind a fence that predicates are not pushed through.

    A predicate pushed below these projections (one that a query states, or that
    Catalyst infers from an explode) would hold their whole product again, and
    evaluate it once more for each row. Catalyst pushes nothing through a
    projection that is not deterministic, and this one is not in name only.
    Filters on other columns belong before parsing.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def _cut(v: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first mark, and after it (null without one)."""
    at = F.instr(v, mark)
    return F.when(at > 0, F.substring(v, F.lit(1), at - 1)).otherwise(v), F.when(at > 0, F.substring(v, at + 1, F.length(v)))


def path_segments(path: Column) -> Column:
    """Segments of a path: empty ones and ``.`` go, ``..`` takes the one before it along."""
    parts = F.array_remove(F.array_remove(F.split(path, "/"), ""), ".")
    popped = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.when(path.contains(".."), popped).otherwise(parts)


def query_pairs(query: Column) -> Column:
    """(name, value) of each part of a query, in order; ``?a`` has a null value, ``?a=`` an empty one; empty names go."""
    def one(p: Column) -> Column:
        name, value = _cut(p, "=")
        return F.struct(name.alias("name"), value.alias("value"))

    # A part without a name is empty or begins with the mark.
    named = F.array_remove(F.split(query, "&"), "")
    named = F.when(query.startswith("=") | query.contains("&="), F.filter(named, lambda p: ~p.startswith("="))).otherwise(named)
    return F.when(query.isNull() | (query == ""), F.array().cast(_PARAM)).otherwise(F.transform(named, one))


def query_params(pairs: Column) -> Column:
    """The pairs of a query by first place of a name and its last value. ``pairs`` is a column of its own, as it is read several times."""
    names = F.array_distinct(pairs["name"])
    last = F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"].alias("value")))
    return F.when(F.size(names) == F.size(pairs), pairs).otherwise(last)


_FIELDS = ("original", "kind", "scheme", "host", "port", "path_segments", "query", "params", "fragment", "nss", "canonical", "error")


def parsed() -> Column:
    """The fields that ``parse_fields`` gives as one struct. Of a field of it alone, no more than that is computed."""
    return F.struct(*(F.col(f"_i_{name}").alias(name) for name in _FIELDS))


def parse_urls(df: DataFrame, col: str = "url", out: str = "iri") -> DataFrame:
    """``df`` plus a struct: original, kind (url or urn), scheme, host, port, path_segments, query, params, fragment, nss, canonical, error.

    A failure is data: error says what is wrong and the other fields but
    original are null. Null input is an error like empty input. A port beyond
    64 bits is an error. All columns pass through.
    """
    return parse_fields(df, col).select(*df.columns, parsed().alias(out))


def parse_fields(df: DataFrame, col: str = "url") -> DataFrame:
    """``df`` plus the fields of ``parse_urls`` as columns of their own, each behind a fence, so that those nobody reads are pruned."""
    base = df.select(*df.columns, F.coalesce(F.btrim(F.col(col), F.lit(STRIP)), F.lit("")).alias("_x"))
    base = base.select(*df.columns, "_x", F.regexp_extract("_x", SCHEME, 1).alias("_s"))
    has = F.col("_s") != ""
    rest = F.substring("_x", F.length("_s") + 2, F.length("_x"))
    base = base.select(*df.columns, "_x", F.when(has, F.lower("_s")).alias("_s"), F.when(has, rest).alias("_r"))
    slashed = F.col("_r").startswith("//") & (F.col("_s") != "urn")
    body = F.when(slashed, F.substring("_r", F.lit(3), F.length("_r"))).when(F.col("_s").isNull() & F.regexp_like("_x", F.lit(HOSTISH)), F.col("_x"))
    base = base.select(*df.columns, "_x", "_s", "_r", body.alias("_b"))
    base = base.select(*df.columns, "_x", "_s", "_r", "_b", F.regexp_extract("_b", _BEFORE, 1).alias("_a"))
    known = F.regexp_like("_a", F.lit(_HOSTS[0]))
    pick = [F.when(known, F.regexp_extract("_a", _HOSTS[0], k)).otherwise(F.regexp_extract("_a", _HOSTS[1], k)) for k in (1, 2)]
    tail = F.substring("_b", F.length("_a") + 1, F.length("_b"))
    base = base.select(*df.columns, "_x", "_s", "_r", "_b", pick[0].alias("_h"), pick[1].alias("_p"), tail.alias("_t"))
    base = base.select(*df.columns, "_x", "_s", "_r", "_b", lower_each(F.col("_h")).alias("_h"), "_p", "_t")
    error = (
        F.when(F.col("_x") == "", "input is empty")
        .when((F.col("_s") == "urn") & (F.col("_r") == ""), "urn without content")
        .when(F.col("_s").isNotNull() & (F.col("_r") == ""), "scheme without content")
        .when(F.col("_s").isNull() & F.col("_b").isNull(), "neither a scheme nor a host")
        .when(F.col("_b").isNotNull() & (F.col("_h") == ""), "no authority")
        .when((F.col("_p") != "") & F.col("_p").try_cast("bigint").isNull(), "invalid port")
    )
    before, fragment = _cut(F.col("_t"), "#")
    base = base.select(*df.columns, "_x", "_s", "_r", "_b", "_h", "_p", error.alias("_e"), before.alias("_t"), fragment.alias("_f"))
    path, query = _cut(F.col("_t"), "?")
    fine, url = F.col("_e").isNull(), F.col("_b").isNotNull()
    scheme = F.when(fine, F.coalesce("_s", F.lit("https")))
    base = base.select(*df.columns, "_r", "_h", "_p", "_e", "_f", (fine & url).alias("_u"), scheme.alias("_s"), path.alias("_t"), query.alias("_q"))
    port = F.when((F.col("_p") != ""), F.col("_p").try_cast("bigint"))
    default = F.coalesce(*(F.when((F.col("_s") == k) & (port == v), F.lit(True)) for k, v in L.DEFAULT_PORTS.items()), F.lit(False))
    u, fine = F.col("_u"), F.col("_e").isNull()
    base = base.select(
        *df.columns, "_e", "_u", "_s", "_q", "_f",
        F.when(fine, F.when(u, F.col("_h")).otherwise("")).alias("_h"),
        F.when(u & ~default, port).alias("_p"),
        F.when(fine, F.when(u, path_segments(F.coalesce("_t", F.lit("")))).otherwise(F.array().cast("array<string>"))).alias("_g"),
        fenced(F.when(fine, F.when(u, query_pairs(F.col("_q"))).otherwise(F.array().cast(_PARAM)))).alias("_a"),
        F.when(fine & ~u, F.col("_r")).alias("_n"),
    )
    tail = F.concat(F.when(F.col("_q").isNotNull() & (F.col("_q") != ""), F.concat(F.lit("?"), "_q")).otherwise(""), F.when(F.col("_f").isNotNull() & (F.col("_f") != ""), F.concat(F.lit("#"), "_f")).otherwise(""))
    whole = F.concat("_s", F.lit("://"), "_h", F.when(F.col("_p").isNotNull(), F.concat(F.lit(":"), F.col("_p").cast("string"))).otherwise(""), F.when(F.size("_g") > 0, F.concat(F.lit("/"), F.array_join("_g", "/"))).when(tail != "", "/").otherwise(""), tail)
    canonical = F.when(u, whole).when(F.col("_e").isNull(), F.concat("_s", F.lit(":"), "_n"))
    fields = {
        "original": F.col(col), "kind": F.when(u, "url").when(F.col("_e").isNull(), "urn"), "scheme": F.col("_s"), "host": F.col("_h"), "port": F.col("_p"), "path_segments": F.col("_g"),
        "query": F.when(u, F.col("_q")), "params": query_params(F.col("_a")), "fragment": F.when(u, F.col("_f")), "nss": F.col("_n"), "canonical": canonical, "error": F.col("_e"),
    }
    return base.select(*df.columns, *(fenced(fields[name]).alias(f"_i_{name}") for name in _FIELDS))


def walled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these columns behind a generator of one row, for keys of joins.

    For the key of a join Catalyst looks for a partitioned table by writing the
    key as an expression over each plan below, which doubles it again and again
    where steps read columns several times. It doesn't look through a generator.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode(F.array(F.struct(*names))).alias("_w")).select(*others, *(F.col("_w")[n].alias(n) for n in names))


def host_of_url(url: Column) -> Column:
    """The lower-cased host of a URL with a scheme, else null: for SQL, where ``parse_urls`` can't be called."""
    return F.nullif(F.lower(F.regexp_extract(F.btrim(url, F.lit(STRIP)), r"^(?!(?i:urn):)[a-zA-Z][a-zA-Z0-9+\-.]*://([^/?#:]+)", 1)), F.lit(""))


def with_types(df: DataFrame, activations: Sequence[Activation] = (), *, iri: Column | str = "iri") -> DataFrame:
    """``df`` plus parts, types and entries: array of (value, type, variable, hint).

    parts are the path segments of a URL; of a URN, its namespace and value.
    entries are null where parsing failed.
    """
    i = F.col(iri) if isinstance(iri, str) else iri
    ns, value = _cut(i["nss"], ":")
    parts = F.when(i["kind"] == "url", i["path_segments"]).when(i["kind"] == "urn", F.array_compact(F.array(ns, value)))
    # Fenced, as an entry reads types of other parts: inlined into the entries they would be found again for each.
    df = df.withColumn("parts", fenced(parts))
    df = df.withColumn("types", fenced(F.transform("parts", lambda s: classify(s, activations))))

    def entry(s: Column, k: Column) -> Column:
        t = F.get("types", k)
        hinted = (k > 0) & t.isin(L.HINTED_TYPES) & (F.get("types", k - 1) == "literal")
        hint = F.when(hinted, F.concat(singularize(F.get("parts", k - 1)), F.when(t == "uuid", "_uuid").otherwise("_id")))
        return F.struct(s.alias("value"), t.alias("type"), (t != "literal").alias("variable"), hint.alias("hint"))

    return df.withColumn("entries", fenced(F.transform("parts", entry)))


def _token(e: Column, hints: bool, canonical: bool) -> Column:
    shown = F.when(e["variable"], F.coalesce(F.concat(F.lit("{"), e["hint"], F.lit("}")), placeholder(e["type"])) if hints else placeholder(e["type"])).otherwise(e["value"])
    return F.coalesce(canonical_form(e["type"], e["value"]), shown) if canonical else shown


def path_shape(entries: Column, hints: bool = True, canonical: bool = False) -> Column:
    """``/`` and the tokens of the entries: values of literals, placeholders of others."""
    return F.concat(F.lit("/"), F.array_join(F.transform(entries, lambda e: _token(e, hints, canonical)), "/"))


def locators(entries: Column) -> Column:
    """For each entry the way that leads to it: ``/`` and a token for each entry before it, with raw type names."""
    def step(a: Column, e: Column) -> Column:
        return F.array_append(a, F.concat(F.element_at(a, -1), F.lit("/"), F.when(e["variable"], F.concat(F.lit("{"), e["type"], F.lit("}"))).otherwise(e["value"])))

    return F.aggregate(entries, F.array(F.lit("")), step, lambda a: F.slice(a, F.lit(1), F.size(a) - 1))


def keying_host(host: Column, strategy: str = "full") -> Column:
    if strategy == "full":
        return host
    if strategy == "registrable":
        return registrable_domain(host)
    if strategy == "none":
        return F.when(host.isNotNull(), "")
    raise ValueError(f"unknown host strategy: {strategy}")


def with_shapes(df: DataFrame, strategy: str = "full", *, iri: Column | str = "iri") -> DataFrame:
    """``df`` (after ``with_types``) plus shape, raw_shape, keying_host, cluster_key and cluster_shape."""
    i = F.col(iri) if isinstance(iri, str) else iri
    url = i["kind"] == "url"
    df = df.withColumn("shape", fenced(F.when(url, path_shape(F.col("entries"))).when(i["kind"] == "urn", "/"))).withColumn("raw_shape", fenced(F.when(url, path_shape(F.col("entries"), False)).when(i["kind"] == "urn", "/")))
    df = df.withColumn("keying_host", fenced(F.when(url, keying_host(i["host"], strategy)).when(i["kind"] == "urn", "")))
    last = F.get("entries", F.lit(1))
    value = F.when(last["value"].isNull() | (last["value"] == ""), "").when(~last["variable"], last["value"]).otherwise(F.coalesce(F.concat(F.lit("{"), last["hint"], F.lit("}")), F.concat(F.lit("{"), last["type"], F.lit("}"))))
    key = F.when(url, F.concat(i["scheme"], F.lit("://"), "keying_host", "shape")).when(i["kind"] == "urn", F.concat(i["scheme"], F.lit(":"), F.get("parts", F.lit(0)), F.lit(":"), value))
    df = df.withColumn("cluster_key", fenced(key))
    return df.withColumn("cluster_shape", F.when(url, F.col("shape")).otherwise(F.col("cluster_key")))


def with_params(df: DataFrame, *, iri: Column | str = "iri", out: str = "typed_params") -> DataFrame:
    """``df`` plus the parameters by name: array of (name, value, type, lifted, form).

    type is by the value alone, lifted by its name too, form the canonical one
    or null; a null value counts as empty. Each step reads fields of the one
    before, so that no rule is stated twice.
    """
    i = F.col(iri) if isinstance(iri, str) else iri
    p = F.transform(F.array_sort(i["params"]), lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["value"], F.lit("")).alias("value")))
    p = F.transform(p, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), classify(p["value"]).alias("type")))
    p = F.transform(p, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), p["type"].alias("type"), F.coalesce(param_name_hint(p["name"], p["type"]), p["type"]).alias("lifted")))
    p = F.transform(p, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), p["type"].alias("type"), p["lifted"].alias("lifted"), canonical_form(p["lifted"], p["value"]).alias("form")))
    return df.withColumn(out, fenced(p))


def rendered(p: Column) -> Column:
    """A parameter's value as it is normalised: canonical, a placeholder, or itself."""
    return F.coalesce(p["form"], F.when(p["lifted"] != "literal", placeholder(p["lifted"])), p["value"])


def rendered_query(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit("="), rendered(p))), "&")


def before_path(iri: Column) -> Column:
    """What a URL has before its path."""
    return F.concat(iri["scheme"], F.lit("://"), iri["host"], F.when(iri["port"].isNotNull(), F.concat(F.lit(":"), iri["port"].cast("string"))).otherwise(""))


def path_tokens(entries: Column, hints: bool = True) -> Column:
    """The tokens of a normal form's path."""
    return F.transform(entries, lambda e: _token(e, hints, True))


def normalized(entries: Column, iri: Column, path: Column, query: Column, hints: bool = True) -> Column:
    """The normal form of a URL or URN from its rendered path and query; null where parsing failed."""
    url = F.concat(before_path(iri), path, F.when(F.size(iri["params"]) > 0, F.concat(F.lit("?"), query)).otherwise(""))
    shaped = F.concat(F.lit("urn:"), F.get(entries, F.lit(0))["value"], F.lit(":"), _token(F.get(entries, F.lit(1)), hints, True))
    return F.when(iri["kind"] == "url", url).when((iri["scheme"] == "urn") & (F.size(entries) == 2), shaped).otherwise(iri["canonical"])


def normalize_urls(df: DataFrame, col: str = "url", out: str = "normalized", *, hints: bool = True, activations: Sequence[Activation] = ()) -> DataFrame:
    """``df`` plus the normal form of a URL column; null where it cannot be parsed."""
    typed = with_params(with_types(parse_fields(df, col), activations, iri=parsed()), iri=parsed(), out="_params")
    return typed.select(*df.columns, normalized(F.col("entries"), parsed(), path_shape(F.col("entries"), hints, True), rendered_query(F.col("_params")), hints).alias(out))
