"""SQL functions: temporary ones that Catalyst inlines, so no Python runs for them.

Functions of values (``FUNCTIONS``) are expressions. Those that take several steps
(``TABLES``) are table functions, to be joined LATERAL: the parts of a URL, its
segments and parameters with their types, and the URLs of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from . import values
from .extract import candidate_pattern
from .urls import AUTHORITY, HOSTISH, SCHEME, STRIP, host_of_url

#: Function name to (parameters, expression over columns of these names).
FUNCTIONS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "url_value_type": (("v",), values.classify),
    "url_display_type": (("t",), values.display_type),
    "url_param_type": (("n", "v"), lambda n, v: F.coalesce(values.param_name_hint(n, values.classify(v)), values.classify(v))),
    "url_canonical_date": (("v",), values.canonical_date),
    "url_canonical_currency": (("v",), values.canonical_currency),
    "url_file_kind": (("v",), values.file_kind),
    "url_singular": (("v",), values.singularize),
    "url_registrable_domain": (("h",), values.registrable_domain),
    "url_host": (("u",), host_of_url),
}


def _q(text: str) -> str:
    """A SQL string."""
    return "'" + "".join(f"\\u{ord(c):04x}" if c in "'\\\"" or ord(c) < 32 or ord(c) > 126 else c for c in text) + "'"


def _cut(column: str, mark: str, before: str, after: str) -> str:
    """What stands before the first mark, and after it (null without one)."""
    at = f"instr({column}, '{mark}')"
    return f"if({at} > 0, substring({column}, 1, {at} - 1), {column}) AS {before}, if({at} > 0, substring({column}, {at} + 1), NULL) AS {after}"


def _parts() -> str:
    own = " OR ".join(f"s = '{k}' AND port = {v}" for k, v in L.DEFAULT_PORTS.items())
    step = f"SELECT coalesce(btrim(u, {_q(STRIP)}), '') AS x"
    step = f"SELECT x, nullif(lower(regexp_extract(x, {_q(SCHEME)}, 1)), '') AS s FROM ({step})"
    step = f"SELECT x, s, substring(x, length(s) + 2) AS r FROM ({step})"
    step = f"SELECT *, CASE WHEN startswith(r, '//') AND s <> 'urn' THEN substring(r, 3) WHEN s IS NULL AND x RLIKE {_q(HOSTISH)} THEN x END AS b FROM ({step})"
    step = f"SELECT *, if(b RLIKE {_q(HOSTISH)}, {_q(HOSTISH)}, {_q(AUTHORITY)}) AS pattern FROM ({step})"
    step = f"SELECT *, regexp_extract(b, pattern, 1) AS h0, regexp_extract(b, pattern, 2) AS p, regexp_extract(b, pattern, 3) AS t FROM ({step})"
    step = f"SELECT *, if(h0 RLIKE {_q('[^\\x00-\\x7F]')}, array_join(transform(split(h0, ''), c -> lower(c)), ''), lower(h0)) AS h FROM ({step})"
    step = f"""SELECT *, try_cast(nullif(p, '') AS BIGINT) AS port, {_cut("t", "#", "t1", "f")}, CASE WHEN x = '' THEN 'input is empty' WHEN s = 'urn' AND r = '' THEN 'urn without content' WHEN s IS NOT NULL AND r = '' THEN 'scheme without content'
      WHEN s IS NULL AND b IS NULL THEN 'neither a scheme nor a host' WHEN b IS NOT NULL AND h = '' THEN 'no authority' WHEN p <> '' AND try_cast(p AS BIGINT) IS NULL THEN 'invalid port' END AS e FROM ({step})"""
    step = f"""SELECT e, r, h, port, f, e IS NULL AND b IS NOT NULL AS au, if(e IS NULL, coalesce(s, 'https'), NULL) AS s, {_cut("t1", "?", "path", "q")} FROM ({step})"""
    step = f"""SELECT *, filter(split(if(au, coalesce(path, ''), ''), '/'), x -> x <> '' AND x <> '.') AS g0, if(au AND NOT coalesce({own}, false), port, NULL) AS p,
      filter(transform(split(if(au, coalesce(q, ''), ''), '&'), x -> named_struct('name', if(instr(x, '=') > 0, substring(x, 1, instr(x, '=') - 1), x), 'value', if(instr(x, '=') > 0, substring(x, instr(x, '=') + 1), NULL))), x -> x.name <> '') AS a0 FROM ({step})"""
    step = f"""SELECT *, if(array_contains(g0, '..'), aggregate(g0, cast(array() AS ARRAY<STRING>), (a, x) -> if(x = '..', slice(a, 1, greatest(size(a) - 1, 0)), array_append(a, x))), g0) AS g,
      transform(array_distinct(transform(a0, x -> x.name)), n -> named_struct('name', n, 'value', element_at(filter(a0, x -> x.name = n), -1).value)) AS a,
      concat(if(coalesce(q, '') <> '', concat('?', q), ''), if(coalesce(f, '') <> '', concat('#', f), '')) AS tail FROM ({step})"""
    return f"""SELECT if(e IS NULL, if(au, 'url', 'urn'), NULL), s, if(e IS NULL, if(au, h, ''), NULL), p, if(e IS NULL, g, NULL), if(au, q, NULL), if(e IS NULL, a, NULL), if(au, f, NULL), if(e IS NULL AND NOT au, r, NULL),
      CASE WHEN au THEN concat(s, '://', h, coalesce(concat(':', p), ''), CASE WHEN size(g) > 0 THEN concat('/', array_join(g, '/')) WHEN tail <> '' THEN '/' ELSE '' END, tail) WHEN e IS NULL THEN concat(s, ':', r) END, e FROM ({step})"""


def _found() -> str:
    marks = _q("[" + "".join(f"\\{c}" for c in L.EXTRACT_TRAILING) + "]+\\z")
    step = f"regexp_replace(v, {marks}, '')"
    for a, b in ("()", "[]", "{}"):
        step = f"aggregate(array({step}), '', (_, w) -> if(endswith(w, '{b}') AND length(replace(w, '{b}', '')) < length(replace(w, '{a}', '')), substring(w, 1, length(w) - 1), w))"
    # A step takes a character away at least, or nothing is left to go: no more than the marks and brackets at the end.
    ends = _q("[" + "".join(f"\\{c}" for c in L.EXTRACT_TRAILING + ")]}") + "]+\\z")
    trimmed = f"aggregate(sequence(0, length(raw) - length(regexp_replace(raw, {ends}, ''))), raw, (v, _) -> {step})"
    return f"SELECT pos, canonical FROM (SELECT pos, {trimmed} AS url FROM (SELECT posexplode(regexp_extract_all(text, {_q(candidate_pattern())}, 0)) AS (pos, raw))), LATERAL url_parts(url) WHERE error IS NULL"


#: Table function to (parameter, columns, body). Later ones use earlier ones.
TABLES: dict[str, tuple[str, str, Callable[[], str]]] = {
    "url_parts": ("u", "kind STRING, scheme STRING, host STRING, port BIGINT, path_segments ARRAY<STRING>, query STRING, params ARRAY<STRUCT<name: STRING, value: STRING>>, fragment STRING, nss STRING, canonical STRING, error STRING", _parts),
    "url_segments": ("u", "pos INT, value STRING, type STRING", lambda: "SELECT pos, value, url_value_type(value) FROM (SELECT posexplode(path_segments) AS (pos, value) FROM url_parts(u) WHERE kind = 'url')"),
    "url_params": ("u", "name STRING, value STRING, type STRING", lambda: "SELECT x.name, x.value, url_value_type(coalesce(x.value, '')) FROM (SELECT explode(params) AS x FROM url_parts(u) WHERE kind = 'url')"),
    "url_found": ("text", "pos INT, url STRING", _found),
}


def text_of(df: DataFrame) -> str:
    """SQL of the only column of a projection, as Spark analysed it."""
    return df._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()


#: Whether Spark puts all steps of a table function into one expression, which states what several steps read again and again.
_INLINE = "spark.sql.optimizer.optimizeOneRowRelationSubquery.alwaysInline"


def register(spark: SparkSession) -> list[str]:
    """Makes ``FUNCTIONS`` temporary SQL functions of the session; gives their names. They take and give strings; null gives null.

    The steps of ``TABLES`` stay projections of their own, by a setting of the session.
    """
    spark.conf.set(_INLINE, "false")
    for name, (parameters, made) in FUNCTIONS.items():
        none = spark.createDataFrame([], ", ".join(f"{p} string" for p in parameters))
        given = reduce(and_, (F.col(p).isNotNull() for p in parameters))
        body = text_of(none.select(F.when(given, made(*map(F.col, parameters))).alias("x")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} STRING' for p in parameters)}) RETURNS STRING RETURN {body}")
    for name, (parameter, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} STRING) RETURNS TABLE({columns}) RETURN {body()}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION url_canonical(u STRING) RETURNS STRING RETURN (SELECT canonical FROM url_parts(u))")
    return [*FUNCTIONS, *TABLES, "url_canonical"]
