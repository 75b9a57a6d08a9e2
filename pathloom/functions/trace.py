"""Why a URL is normalised as it is: one row for each segment and parameter, with notes and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from .urls import fenced, normalized, parse_fields, parsed, path_shape, rendered, rendered_query, with_params, with_types
from .values import canonical_form, display_type, placeholder, singularize

_ROW = "array<struct<name:string,value:string,type:string,output:string,notes:array<string>>>"


def _form_note(t: Column, v: Column, form: Column) -> Column:
    """Notes on a canonical form that differs from the value, and on the common name of addresses."""
    kind = F.when(t == "date", "canonical date").otherwise("currency upcase")
    changed = F.when(form != v, F.concat(kind, F.lit(" ("), v, F.lit(" → "), form, F.lit(")")))
    return F.coalesce(changed, F.when(t.isin("ipv4", "ipv6"), F.concat(F.lit("ip umbrella collapse ("), t, F.lit(" → ip)"))))


def _path_rows(hints: bool) -> Column:
    def would(e: Column, k: Column) -> Column:
        before = F.get("entries", k - 1)
        named = F.when((k > 0) & (before["type"] == "literal"), F.concat(singularize(before["value"]), F.lit("_id")))
        return F.struct(e["value"].alias("value"), e["type"].alias("type"), e["variable"].alias("variable"), e["hint"].alias("hint"), canonical_form(e["type"], e["value"]).alias("form"), named.alias("would"))

    def one(e: Column) -> Column:
        form = e["form"]
        kept = F.when(e["variable"] & form.isNull() & e["hint"].isNull() & ~e["type"].isin(L.HINTED_TYPES) & F.lit(hints), F.concat(F.lit("semantic type — surfaced as {"), display_type(e["type"]), F.lit("}, not {"), e["would"], F.lit("}")))
        shown = F.coalesce(F.concat(F.lit("{"), e["hint"], F.lit("}")), placeholder(e["type"])) if hints else placeholder(e["type"])
        output = F.coalesce(form, F.when(e["variable"], shown).otherwise(e["value"]))
        notes = F.array_compact(F.array(_form_note(e["type"], e["value"], form), kept))
        return F.struct(F.lit("").alias("name"), e["value"].alias("value"), e["type"].alias("type"), output.alias("output"), notes.alias("notes"))

    return F.transform(F.transform("entries", would), one)


def _query_rows(params: Column) -> Column:
    def one(p: Column) -> Column:
        lifted = F.when(p["lifted"] != p["type"], F.concat(F.lit("param-name hint (`"), p["name"], F.lit("=`) lifted "), p["type"], F.lit(" → "), p["lifted"]))
        return F.struct(p["name"].alias("name"), p["value"].alias("value"), p["lifted"].alias("type"), rendered(p).alias("output"), F.array_compact(F.array(lifted, _form_note(p["lifted"], p["value"], p["form"]))).alias("notes"))

    return F.transform(params, one)


def explain_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """``df`` plus pos and the fields of each entry, one row each; rows that cannot be parsed or have no parts give none."""
    typed = with_types(parse_fields(df, col), iri=parsed())
    return typed.select(*df.columns, F.posexplode("entries").alias("pos", "_e")).select(*df.columns, "pos", "_e.*")


def trace_urls(df: DataFrame, col: str = "url", *, hints: bool = True) -> DataFrame:
    """``df`` plus trace: struct of input, normalized, scheme, host, port, path, query (rows with notes) and evidence.

    evidence has (subject_kind, subject, source, payload) for each part and
    parameter: what the classifier said of it, and each note. Null where
    parsing failed.
    """
    typed = with_params(with_types(parse_fields(df, col), iri=parsed()), iri=parsed(), out="_params")
    typed = typed.withColumn("_path", fenced(_path_rows(hints))).withColumn("_query", fenced(_query_rows(F.col("_params"))))
    i = parsed()

    def said(kind: str) -> object:
        def one(r: Column, k: Column) -> Column:
            subject = F.when(r["name"] == "", k.cast("string")).otherwise(r["name"])
            payload = F.create_map(F.lit("value"), r["value"], F.lit("type"), r["type"], F.lit("output"), r["output"])
            first = F.struct(F.lit(kind).alias("subject_kind"), subject.alias("subject"), F.lit("classifier").alias("source"), payload.alias("payload"))
            noted = F.transform(r["notes"], lambda n: F.struct(F.lit(kind).alias("subject_kind"), subject.alias("subject"), F.lit("note").alias("source"), F.create_map(F.lit("note"), n).alias("payload")))
            return F.concat(F.array(first), noted)

        return one

    evidence = F.concat(F.flatten(F.transform("_path", said("segment"))), F.flatten(F.transform("_query", said("param"))))
    made = F.struct(i["canonical"].alias("input"), normalized(F.col("entries"), i, path_shape(F.col("entries"), hints, True), rendered_query(F.col("_params")), hints).alias("normalized"), i["scheme"].alias("scheme"), i["host"].alias("host"), i["port"].alias("port"), F.col("_path").cast(_ROW).alias("path"), F.col("_query").cast(_ROW).alias("query"), evidence.alias("evidence"))
    return typed.select(*df.columns, fenced(F.when(i["error"].isNull(), made)).alias("trace"))
