"""What a corpus says of slots: verdicts on path segments, types and summaries of parameters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.values import param_name_hint
from ..sources.tables import kept
from .views import PARAM, POSITION, Observed, clusters, counted, counted_params, first_come


def undecided(t: Column) -> Column:
    """Whether evidence decides on a segment of type ``t``: all others are variable whatever a corpus says."""
    return t.isin("literal", *L.STABLE_TYPES)


def position_evidence(o: Observed, cap: int = L.VALUE_CAP, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, values): totals, variable share and cardinality of each position; the count of each tracked value. ``asked`` are positions, if others don't matter.

    Both come from one count of distinct values, which is kept: each reads other
    columns of it, so Spark would not share its shuffle but parse the log twice.
    """
    segments = o.segments if asked is None else o.segments.join(asked, POSITION, "left_semi")
    c = kept(counted(segments, POSITION), "counted")
    free = F.sum(F.when(F.col("type") != "literal", F.col("n")).otherwise(0))
    positions = c.groupBy(*POSITION).agg(F.sum("n").alias("total"), free.alias("variable_count"), F.least(F.count("*"), F.lit(cap)).alias("cardinality"))
    return positions, first_come(c, POSITION, cap).select(*POSITION, "value", F.col("n").alias("value_count"))


def verdict(t: Column, total: Column, variable_count: Column, cardinality: Column, value_count: Column) -> Column:
    """The class of a segment of type ``t`` given its position's evidence; nulls stand for no evidence, or an untracked value."""
    variable, none = t != "literal", total.isNull() | (total == 0)
    share = F.coalesce(value_count, F.lit(0)) / total
    enough = total >= L.MIN_OBSERVATIONS
    spread = cardinality / total
    popular = (value_count >= 5) & (share >= 3 / cardinality)
    rare = F.when(value_count.isNotNull(), "rare_literal").otherwise("ambiguous")
    return (
        F.when(variable & ~t.isin(L.STABLE_TYPES), "variable_identifier")
        .when(none, F.when(variable, "variable_identifier").otherwise("ambiguous"))
        .when(variable, F.when(enough & (share >= 0.5), "stable_literal").otherwise("variable_identifier"))
        .when(enough & (variable_count / total >= 0.8), rare)
        .when(share >= 0.5, "stable_literal")
        .when(enough & ((spread >= 0.8) | ((spread >= 0.5) & (cardinality >= 20))), F.when(F.coalesce(popular, F.lit(False)), "stable_literal").otherwise("corpus_inferred_variable"))
        .when(cardinality == 1, "stable_literal")
        .otherwise(rare)
    )


def explained(segments: DataFrame, positions: DataFrame, values: DataFrame) -> DataFrame:
    """``segments`` plus the evidence of their positions and values, and the verdict."""
    s = segments.join(positions, POSITION, "left").join(values, [*POSITION, "value"], "left")
    return s.withColumn("verdict", verdict(*(F.col(c) for c in ("type", "total", "variable_count", "cardinality", "value_count"))))


def param_stats(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """One row a (cluster, parameter): counts by type and value in the form the ladder reads, all from one count of distinct values, which is kept: it is read twice."""
    return _param_stats(kept(counted_params(o), "counted"), cap)


def _param_stats(c: DataFrame, cap: int) -> DataFrame:
    n, t = F.col("n"), F.col("type")
    number = F.when(t.isin("integer", "float"), F.col("value").try_cast("double"))
    c = c.withColumn("x", F.when(F.abs(number) < float("inf"), number))
    num_n = F.when(F.col("x").isNotNull(), n)
    types = c.groupBy(*PARAM, "type").agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.sum(num_n).alias("xn"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x") * n).alias("xs"))

    def of(kind: str) -> Column:
        return F.sum(F.when(t == kind, n).otherwise(0))

    stats = types.groupBy(*PARAM).agg(
        F.sum("n").alias("total"),
        F.min_by("type", F.struct(-n, t)).alias("dominant"),
        F.min_by(F.when(t != "date", t), F.when(t != "date", F.struct(-n, t))).alias("dominant_undated"),
        of("date").alias("dates"), of("integer").alias("integers"), of("float").alias("floats"),
        F.least(F.sum("d"), F.lit(cap)).alias("cardinality"),
        F.sum("xn").alias("num_count"), F.min("lo").alias("num_min"), F.max("hi").alias("num_max"), F.sum("xs").alias("num_sum"),
    )
    stats = stats.withColumn("num_avg", F.col("num_sum") / F.col("num_count"))
    often = first_come(c, PARAM, cap).where(n >= 3).groupBy(*PARAM).agg(F.count("*").alias("established"), F.sum("n").alias("established_count"))
    return stats.join(often, PARAM, "left").fillna(0, ["established", "established_count"])


class Evidence(NamedTuple):
    """What explanations and normal forms ask of a corpus: a row a position, a row a tracked value, a row a parameter."""

    positions: DataFrame
    values: DataFrame
    params: DataFrame


def evidence(o: Observed, cap: int = L.VALUE_CAP, asked: DataFrame | None = None) -> Evidence:
    """The evidence of a log; of positions those ``asked`` for, if given."""
    return Evidence(*position_evidence(o, cap, asked), param_stats(o, cap))


def evidence_of(views: dict[str, DataFrame]) -> Evidence:
    """The same from the materialised views, which are much smaller than the log."""
    free = F.sum(F.when(F.col("type") != "literal", F.col("n")).otherwise(0))
    positions = views["position_types"].groupBy(*POSITION).agg(F.sum("n").alias("total"), free.alias("variable_count"))
    tracked = views["position_values"].groupBy(*POSITION).agg(F.count("*").alias("cardinality"))
    values = views["position_values"].select(*POSITION, "value", F.col("n").alias("value_count"))
    n, t = F.col("n"), F.col("type")
    params = views["cluster_param_types"].groupBy(*PARAM).agg(
        F.sum("n").alias("total"),
        F.min_by("type", F.struct(-n, t)).alias("dominant"),
        F.min_by(F.when(t != "date", t), F.when(t != "date", F.struct(-n, t))).alias("dominant_undated"),
        *(F.sum(F.when(t == kind, n).otherwise(0)).alias(name) for kind, name in (("date", "dates"), ("integer", "integers"), ("float", "floats"))),
    )
    often = F.when(n >= 3, n)
    known = views["cluster_param_values"].groupBy(*PARAM).agg(F.count("*").alias("cardinality"), F.count(often).alias("established"), F.coalesce(F.sum(often), F.lit(0)).alias("established_count"))
    numbers = views["cluster_param_numeric"].withColumn("num_avg", F.col("num_sum") / F.col("num_count"))
    return Evidence(positions.join(tracked, POSITION), values, params.join(known, PARAM).join(numbers, PARAM, "left"))


def ladder(name: Column) -> Column:
    """The type of a parameter over columns of ``param_stats``."""
    c = F.col
    t, total, card = c("dominant"), c("total"), c("cardinality")
    counted = (t == "integer") & (F.coalesce(c("num_count"), F.lit(0)) > 0) & (card >= 2) & (total >= L.MIN_OBSERVATIONS)
    number = t.isin("integer", "float") & (c("integers") / total < 0.8) & (c("floats") / total < 0.8) & ((c("integers") + c("floats")) / total >= 0.8)
    return (
        F.when(total == 0, "literal")
        .when(counted & (card <= 150) & (c("num_min") >= 1900) & (c("num_max") <= 2100), "year")
        .when(counted & (card <= 30) & (c("num_min") >= 100) & (c("num_max") <= 599), "http_status")
        .when((t != "boolean") & (total >= 20) & c("established").between(2, 10) & (c("established_count") / total >= 0.9), "enum")
        .when(t == "date", F.when(c("dates") / total >= 0.8, "date").otherwise(F.coalesce("dominant_undated", F.lit("literal"))))
        .when(number, "number")
        .otherwise(F.coalesce(param_name_hint(name, t), F.when((t == "literal") & (card >= 2), "string").otherwise(t)))
    )


def rounded(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def param_summary(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """(cluster_key, name, type, total, presence, cardinality, confidence, num_min, num_max, num_avg); numbers for numeric types alone."""
    s = param_stats(o, cap).withColumn("type", ladder(F.col("name"))).join(clusters(o).select("cluster_key", F.col("n").alias("cluster_n")), "cluster_key")
    numeric = F.col("type").isin("integer", "float", "number", "year", "http_status")
    shown = [F.when(numeric, F.col(c)).alias(c) for c in ("num_min", "num_max", "num_avg")]
    return s.select("cluster_key", "name", "type", "total", (F.col("total") / F.col("cluster_n")).alias("presence"), "cardinality", rounded(F.col("total") / (F.col("total") + 15), 2).alias("confidence"), *shown)


def _typed(c: DataFrame, kinds: list[str], cap: int) -> DataFrame:
    return _param_stats(c, cap).withColumn("param_type", ladder(F.col("name"))).where(F.col("param_type").isin(kinds))


def _values_and_types(o: Observed, kinds: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """(tracked values, parameters of these kinds), both from the count of distinct values, which is kept: the log is read once, nothing else of it is written."""
    c = kept(counted_params(o), "counted")
    return first_come(c, PARAM, cap).drop("type"), _typed(c, kinds, cap)


def enum_members(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """(cluster_key, name, members): values of enums seen three times or more, most frequent first, then by value."""
    v, typed = _values_and_types(o, ["enum"], cap)
    v = v.where("n >= 3").join(typed.select(*PARAM), PARAM)
    v = v.groupBy(*PARAM).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))).alias("l"))
    return v.select(*PARAM, F.transform("l", lambda x: x["value"]).alias("members"))


def value_distribution(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """(cluster_key, name, value, share) of booleans and enums, to four places."""
    v, typed = _values_and_types(o, ["boolean", "enum"], cap)
    v = v.join(typed.select(*PARAM, "total"), PARAM)
    return v.select(*PARAM, "value", rounded(F.col("n") / F.col("total"), 4).alias("share"))


def subtype_distribution(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """(cluster_key, name, integer_share, float_share) of numbers."""
    return _typed(kept(counted_params(o), "counted"), ["number"], cap).select(*PARAM, rounded(F.col("integers") / F.col("total"), 4).alias("integer_share"), rounded(F.col("floats") / F.col("total"), 4).alias("float_share"))


def kind_distribution(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """(cluster_key, name, kind, share) of file parameters: shares of their tracked values."""
    from ..functions.values import file_kind

    v, typed = _values_and_types(o, ["file"], cap)
    v = v.join(typed.select(*PARAM), PARAM).withColumn("kind", file_kind(F.col("value")))
    v = v.groupBy(*PARAM, "kind").agg(F.sum("n").alias("k"))
    whole = v.groupBy(*PARAM).agg(F.sum("k").alias("all"))
    return v.join(whole, PARAM).select(*PARAM, "kind", rounded(F.col("k") / F.col("all"), 4).alias("share"))


def params_for(o: Observed, urls: DataFrame, cap: int = L.VALUE_CAP) -> DataFrame:
    """The parameter summaries of the clusters that the URLs of another observed table belong to."""
    return param_summary(o, cap).join(urls.select("cluster_key").distinct(), "cluster_key")


def assembled(o: Observed) -> DataFrame:
    """Clusters with their parts, one row each: examples, segment values by position, and parameter summaries."""
    from .views import cluster_examples, segment_stats

    def listed(df: DataFrame, name: str, order: list[str], shown: list[str]) -> DataFrame:
        one = F.array_sort(F.collect_list(F.struct(*order, F.struct(*shown).alias("_v"))))
        return df.groupBy("cluster_key").agg(F.transform(one, lambda x: x["_v"]).alias(name))

    out = clusters(o)
    out = out.join(listed(cluster_examples(o), "examples", ["first_obs"], ["canonical"]), "cluster_key", "left")
    out = out.join(listed(segment_stats(o), "segments", ["pos"], ["pos", "stable", "values"]), "cluster_key", "left")
    summary = param_summary(o).withColumn("_m", -F.col("total"))
    return out.join(listed(summary, "params", ["_m", "name"], ["name", "type", "total", "presence", "confidence"]), "cluster_key", "left")
