"""URLs and URNs in free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from .urls import parse_urls

_INSIDE = r"[^ \t\r\n\x0B\f" + "".join(re.escape(c) for c in L.EXTRACT_BOUNDARIES) + "]+"


def candidate_pattern(scheme_less: bool = True) -> str:
    """What may start a URL: a known scheme, ``urn:`` and a namespace, or a host under a known top-level domain with a path."""
    kinds = [f"(?iu:{'|'.join(L.EXTRACT_SCHEMES)})://{_INSIDE}", r"urn:[a-zA-Z0-9][a-zA-Z0-9\-]{0,30}:" + _INSIDE]
    if scheme_less:
        kinds.append(r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+(?iu:" + "|".join(L.EXTRACT_TLDS) + ")/" + _INSIDE)
    return (r"(?<![A-Za-z0-9_/.@])" if scheme_less else r"(?<![A-Za-z0-9_/])") + "(?:" + "|".join(kinds) + ")"


def trimmed(s: Column) -> Column:
    """Without trailing punctuation and unbalanced closing brackets, until neither is left."""
    marks = "[" + re.escape(L.EXTRACT_TRAILING) + r"]+\z"

    def count(v: Column, c: str) -> Column:
        return F.length(v) - F.length(F.replace(v, F.lit(c), F.lit("")))

    def step(v: Column, _: Column) -> Column:
        v = F.regexp_replace(v, marks, "")
        for opening, closing in ("()", "[]", "{}"):
            v = F.when(v.endswith(closing) & (count(v, closing) > count(v, opening)), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)
        return v

    plain = ~F.regexp_like(s, F.lit("[" + re.escape(L.EXTRACT_TRAILING) + r")\]}]\z"))
    return F.when(plain, s).otherwise(F.aggregate(F.sequence(F.lit(0), F.length(s)), s, step))


def extract_urls(df: DataFrame, col: str = "text", *, scheme_less: bool = True) -> DataFrame:
    """``df`` without the text plus pos and iri, one row for each URL that parses, in the text's order."""
    others = [c for c in df.columns if c != col]
    found = F.regexp_extract_all(F.col(col), F.lit(candidate_pattern(scheme_less)), F.lit(0))
    each = df.select(*others, F.posexplode(found).alias("pos", "_raw"))
    each = parse_urls(each.withColumn("_raw", trimmed(F.col("_raw"))), "_raw")
    return each.where(F.col("iri.error").isNull()).drop("_raw")


def extract_strings(df: DataFrame, col: str = "text", *, scheme_less: bool = True) -> DataFrame:
    """``df`` without the text plus urls: the distinct canonical forms of each row's URLs, in the order of their first places."""
    others = [c for c in df.columns if c != col]
    found = extract_urls(df.select(F.struct(*others).alias("_o"), col), col, scheme_less=scheme_less)
    listed = found.groupBy("_o").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("iri.canonical").alias("u")))).alias("l"))
    return listed.select("_o.*", F.array_distinct(F.transform("l", lambda x: x["u"])).alias("urls"))
