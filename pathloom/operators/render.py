"""Normal forms that a corpus informs: from its final state, or as it stood when each URL arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.urls import before_path, fenced, normalized, path_tokens, rendered
from ..functions.values import canonical_form, param_name_hint, singularize
from ..sources.tables import kept
from .infer import Evidence, evidence, explained, ladder, undecided, verdict
from .running import RunningState, advance
from .views import PARAM, POSITION, Observed


def _segment_tokens(s: DataFrame, hints: bool) -> DataFrame:
    """(obs_id, pos, token) of path segments with their verdicts, but for those that are rendered as by their type alone: literals that stay, variables that vary."""
    c = F.col
    free, literal = c("verdict").isin("variable_identifier", "corpus_inferred_variable"), c("type") == "literal"
    s = s.select("obs_id", "pos", "value", "type", "locator", fenced(free).alias("free")).where(c("free") == literal)
    literals = F.filter(F.split(c("locator"), "/"), lambda p: (p != "") & ~p.startswith("{"))
    s = s.select("obs_id", "pos", "value", "type", "free", fenced(F.when(c("free"), F.try_element_at(literals, F.lit(-1)))).alias("before"))
    inferred = F.coalesce(F.concat(F.lit("{"), singularize(c("before")), F.lit("}")), F.lit("{value}")) if hints else F.lit("{value}")
    return s.select("obs_id", "pos", F.when(c("free"), inferred).otherwise(F.coalesce(canonical_form(c("type"), c("value")), c("value"))).alias("token"))


def _param_tokens(p: DataFrame) -> DataFrame:
    """(obs_id, name, token) of parameters with their cluster's statistics: by these from MIN_OBSERVATIONS on, else by value and name alone."""
    c = F.col
    lifted = F.when(c("total") >= L.MIN_OBSERVATIONS, c("param_type")).otherwise(F.coalesce(param_name_hint(c("name"), c("type")), c("type")))
    p = p.select("obs_id", "name", "value", fenced(lifted).alias("lifted"))
    p = p.withColumn("form", fenced(canonical_form(c("lifted"), c("value"))))
    return p.select("obs_id", "name", F.concat("name", F.lit("="), rendered(F.struct("value", "lifted", "form"))).alias("token"))


def _assembled(urls: DataFrame, segments: DataFrame, params: DataFrame, hints: bool) -> DataFrame:
    """(obs_id, normalized) from (obs_id, pos, token), which replace what a segment's type alone gives, and (obs_id, name, token): URLs, segments and parameters meet in one shuffle by obs_id."""
    i, entries = F.col("iri"), F.col("entries")
    none = F.lit("")
    url = F.when(i["kind"] == "url", F.struct(before_path(i).alias("start"), path_tokens(entries, hints).alias("tokens"), (F.size(i["params"]) > 0).alias("asked")))
    # What is no URL has no slots.
    whole = F.when(i["kind"] != "url", normalized(entries, i, none, none, hints))
    kinds = {"u": None, "w": "string", "s": f"struct<pos:{segments.schema['pos'].dataType.simpleString()},token:string>", "p": "struct<name:string,token:string>"}
    rows = urls.select("obs_id", url.alias("u"), whole.alias("w"), *(F.lit(None).cast(kinds[k]).alias(k) for k in ("s", "p")))
    kinds["u"] = rows.schema["u"].dataType
    for df, k in ((segments, "s"), (params, "p")):
        rows = rows.union(df.select("obs_id", *(F.struct(*df.columns[1:]).alias(k) if k == x else F.lit(None).cast(t).alias(x) for x, t in kinds.items())))
    df = rows.groupBy("obs_id").agg(F.first("u", ignorenulls=True).alias("u"), F.first("w", ignorenulls=True).alias("w"), F.collect_list("s").alias("s"), F.array_sort(F.collect_list("p")).alias("p"))
    replaced = F.transform("u.tokens", lambda t, k: F.coalesce(F.try_element_at(F.filter("s", lambda x: x["pos"] == k), F.lit(1))["token"], t))
    path = F.concat(F.lit("/"), F.array_join(F.when(F.size("s") > 0, replaced).otherwise(F.col("u.tokens")), "/"))
    query = F.when(F.col("u.asked"), F.concat(F.lit("?"), F.array_join(F.transform("p", lambda x: x["token"]), "&"))).otherwise("")
    return df.select("obs_id", F.coalesce(F.concat("u.start", path, query), "w").alias("normalized"))


def corpus_explain(corpus: Observed | Evidence, of: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """(obs_id, pos, value, type, verdict) of the segments of ``of``, by the final state of ``corpus``."""
    known = corpus if isinstance(corpus, Evidence) else evidence(corpus, cap)
    return explained(of.segments, known.positions, known.values).select("obs_id", "pos", "value", "type", "verdict")


def corpus_normalize(corpus: Observed | Evidence, of: Observed, *, hints: bool = True, cap: int = L.VALUE_CAP) -> DataFrame:
    """(obs_id, normalized) of the URLs of ``of``, by the final state of ``corpus``.

    Evidence is kept, as it is small beside the log: where it is small indeed, Spark broadcasts it and moves no slot for a join.
    """
    segments = of.segments.where(undecided(F.col("type")))
    if isinstance(corpus, Evidence):
        known = corpus
    else:
        known = evidence(corpus, cap, kept(segments.select(*POSITION).distinct(), "asked"))
    segments = explained(segments, kept(known.positions, "positions"), kept(known.values, "values"))
    stats = kept(known.params.select(*PARAM, "total", ladder(F.col("name")).alias("param_type")), "stats")
    return _assembled(of.urls, _segment_tokens(segments, hints), _param_tokens(of.params.join(stats, PARAM, "left")), hints)


def running_normalize(o: Observed, *, hints: bool = True, cap: int = L.VALUE_CAP, ranges: int = 0) -> DataFrame:
    """(obs_id, normalized) of every URL by the corpus as it stood when the URL had just been observed."""
    segments, params, _ = advance(o, cap=cap, ranges=ranges, after=False)
    return _judged(o, segments, params, hints)


def _judged(o: Observed, segments: DataFrame, params: DataFrame, hints: bool) -> DataFrame:
    # Fenced before they are judged: the rules read each running column many times.
    segments = segments.select("obs_id", "pos", "value", "type", "locator", *(fenced(F.col(c)).alias(c) for c in ("total", "variable_count", "cardinality", "value_count")))
    segments = segments.withColumn("verdict", fenced(verdict(*(F.col(c) for c in ("type", "total", "variable_count", "cardinality", "value_count")))))
    own = o.params.columns
    params = params.select(*own, *(fenced(F.col(c)).alias(c) for c in params.columns if c not in own))
    params = params.withColumn("param_type", fenced(ladder(F.col("name"))))
    return _assembled(o.urls, _segment_tokens(segments, hints), _param_tokens(params), hints)


def carried_normalize(o: Observed, state: RunningState | None, *, hints: bool = True, cap: int = L.VALUE_CAP, ranges: int = 0) -> tuple[DataFrame, RunningState]:
    """(obs_id, normalized) of the URLs of ``o``, which follow those that ``state`` knows; and what is known of their slots after them."""
    segments, params, touched = advance(o, state, cap=cap, ranges=ranges)
    return _judged(o, segments, params, hints), touched
