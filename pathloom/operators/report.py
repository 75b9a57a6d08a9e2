"""Reports on a corpus: clusters as text and as JSON, one row each, so that they stream out however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .infer import enum_members, kind_distribution, param_summary, subtype_distribution, value_distribution
from .views import PARAM, Observed, cluster_examples, cluster_segments, clusters

#: Examples that the text report shows of a cluster.
SHOWN = 3


def number_text(x: Column) -> Column:
    """A whole number in all its digits, any other rounded to two decimals without a trailing zero; from 1e38 on, in scientific form."""
    places = F.regexp_replace((F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100).cast("decimal(38,2)").cast("string"), r"0\z", "")
    return F.when(F.abs(x) >= 1e35, x.cast("string")).when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(places)


def _listed(df: DataFrame, name: str, order: list[str], shown: Column) -> DataFrame:
    def compare(a: Column, b: Column) -> Column:  # by the order alone: maps have none
        x, y = F.struct(*(a[c] for c in order)), F.struct(*(b[c] for c in order))
        return F.when(x < y, -1).when(x == y, 0).otherwise(1)

    one = F.array_sort(F.collect_list(F.struct(*order, shown.alias("_v"))), compare)
    return df.groupBy("cluster_key").agg(F.transform(one, lambda x: x["_v"]).alias(name))


def cluster_lines(o: Observed, *, hints: bool = True) -> DataFrame:
    """(cluster_key, n, ord, text) of each cluster: count, host and shape, three examples and how many more, and its parameters."""
    out = clusters(o)
    if not hints:
        raw = o.urls.groupBy("cluster_key").agg(F.min_by("raw_shape", "obs_id").alias("raw_shape"))
        out = out.join(raw, "cluster_key").withColumn("shape", F.coalesce("raw_shape", "shape"))
    examples = _listed(cluster_examples(o, SHOWN), "examples", ["first_obs"], F.concat(F.lit("\n    "), "canonical"))
    s = param_summary(o)
    wide = s.groupBy("cluster_key").agg(F.max(F.length("name")).alias("wide"))
    numbers = F.when(F.col("num_min").isNotNull(), F.concat_ws("  ", F.concat(number_text(F.col("num_min")), F.lit(".."), number_text(F.col("num_max"))), F.concat(F.lit("avg "), number_text(F.col("num_avg")))))
    share = F.floor(F.col("presence") * 100 + 0.5).cast("string")
    tail = F.concat(F.lit("("), F.col("cardinality").cast("string"), F.lit(" distinct, "), share, F.lit("%)"))
    line = F.concat(F.lit("\n    "), F.rpad("name", F.col("wide"), F.lit(" ")), F.lit("  "), F.concat_ws("  ", "type", F.when(F.col("confidence") > 0, F.format_string("conf %.2f", "confidence")), numbers, tail))
    params = _listed(s.join(wide, "cluster_key").withColumn("_m", -F.col("total")), "params", ["_m", "name"], line)
    out = out.join(examples, "cluster_key", "left").join(params, "cluster_key", "left")
    more = F.col("n") - F.least(F.coalesce(F.size("examples"), F.lit(0)), F.lit(SHOWN))
    host = F.when(F.col("host") == "", "(urn)").otherwise(F.col("host"))
    text = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), host, F.lit("  "), "shape", F.array_join("examples", ""), F.when(more > 0, F.concat(F.lit("\n    + "), more.cast("string"), F.lit(" more"))).otherwise(""), F.coalesce(F.array_join("params", ""), F.lit("")))
    return out.select("cluster_key", "n", "ord", text.alias("text"))


def _counts(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(x["value"], x["n"])))


def cluster_json(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """(cluster_key, n, ord, json) of each cluster: its examples, the values of its segments and the summaries of its parameters."""
    examples = _listed(cluster_examples(o), "examples", ["first_obs"], F.col("canonical"))
    s = cluster_segments(o).groupBy("cluster_key", "pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value", "n"))).alias("l"))
    segments = _listed(s, "segments", ["pos"], F.struct(F.col("pos").alias("position"), (F.size("l") == 1).alias("stable"), _counts(F.col("l")).alias("values")))
    p = param_summary(o, cap)
    shares = value_distribution(o, cap).groupBy(*PARAM).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "share")))).alias("value_distribution"))
    kinds = kind_distribution(o, cap).groupBy(*PARAM).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "share")))).alias("kind_distribution"))
    parts = subtype_distribution(o, cap).select(*PARAM, F.struct(F.col("integer_share").alias("integer"), F.col("float_share").alias("float")).alias("subtype_distribution"))
    for part in (enum_members(o, cap).withColumnRenamed("members", "values"), shares, parts, kinds):
        p = p.join(part, PARAM, "left")
    fields = F.struct("name", F.col("total").alias("count"), "type", "confidence", "cardinality", "presence", "values", "value_distribution", "subtype_distribution", "kind_distribution", F.col("num_min").alias("min"), F.col("num_max").alias("max"), F.col("num_avg").alias("avg"))
    params = _listed(p.withColumn("_m", -F.col("total")), "params", ["_m", "name"], fields)
    out = clusters(o).join(examples, "cluster_key", "left").join(segments, "cluster_key", "left").join(params, "cluster_key", "left")
    made = F.struct(F.col("cluster_key").alias("key"), "host", "scheme", "shape", F.col("n").alias("count"), "examples", F.coalesce("segments", F.array()).alias("segments"), F.coalesce("params", F.array()).alias("params"))
    return out.select("cluster_key", "n", "ord", F.to_json(made).alias("json"))
