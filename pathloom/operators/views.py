"""The corpus as views: group-bys over observations.

``observe`` turns a log into three narrow tables; each view is one aggregation
of one of them, so Catalyst prunes what a view does not read. First-come caps
rank distinct values by their first observation, after pre-aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.urls import fenced, locators, parse_fields, parsed, walled, with_shapes, with_types
from ..functions.values import Activation, classify
from ..sources.tables import kept


class Observed(NamedTuple):
    """urls: one row a parsed URL; segments: one a path segment; params: one a parameter."""

    urls: DataFrame
    segments: DataFrame
    params: DataFrame


def observed_urls(log: DataFrame, *, strategy: str = "full", activations: Sequence[Activation] = ()) -> DataFrame:
    """(obs_id, iri, entries, locators, shape, raw_shape, host, cluster_key, cluster_shape) of the URLs that parse."""
    df = with_types(parse_fields(log.select("obs_id", "url")), activations, iri=parsed())
    df = with_shapes(df.where(F.col("_i_error").isNull()), strategy, iri=parsed()).withColumnRenamed("keying_host", "host")
    df = walled(df.withColumn("locators", fenced(locators(F.col("entries")))), "host", "cluster_key", "cluster_shape")
    return df.select("obs_id", parsed().alias("iri"), "entries", "locators", "shape", "raw_shape", "host", "cluster_key", "cluster_shape")


def observe(log: DataFrame, *, strategy: str = "full", activations: Sequence[Activation] = (), keep: bool = False) -> Observed:
    """The tables of a log. Rows that cannot be parsed are left out; an empty log gives empty tables.

    ``keep`` writes the parsed URLs and the typed parameters to the shared
    folder: for uses that read them several times, as all inference does.
    """
    urls = observed_urls(log, strategy=strategy, activations=activations)
    if keep:
        urls = kept(urls, "urls")
    path = urls.where(F.col("iri.kind") == "url")
    segments = path.select("obs_id", "host", "cluster_key", F.posexplode(F.arrays_zip("locators", "entries")).alias("pos", "e"))
    segments = segments.select("obs_id", "host", "cluster_key", F.lit("path").alias("scope"), F.col("e.locators").alias("locator"), "pos", F.col("e.entries.value").alias("value"), F.col("e.entries.type").alias("type"), F.col("e.entries.hint").alias("hint"))
    params = path.select("obs_id", "cluster_key", F.explode("iri.params").alias("p")).select("obs_id", "cluster_key", F.col("p.name").alias("name"), F.coalesce("p.value", F.lit("")).alias("value"))
    # Parameters are typed by the built-in rules alone (``counted_params``): activations are for path segments.
    params = params.withColumn("type", classify(F.col("value")))
    return Observed(urls, segments, kept(params, "params") if keep else params)


def counted(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, type, n, first_obs): the distinct values of each key, from which all that is known of slots follows.

    A type follows from its value, so this has a row for each value.
    """
    return df.groupBy(*keys, "value", "type").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_obs"))


def counted_params(o: Observed) -> DataFrame:
    """``counted`` of the parameters, each distinct value typed once, not each row."""
    c = _values(o.params, PARAM, 0)
    return c.select(*PARAM, "value", fenced(classify(F.col("value"))).alias("type"), "n", "first_obs")


_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_come(counted: DataFrame, keys: list[str], cap: int, *, rank: str = "") -> DataFrame:
    """Of each key the ``cap`` rows that were observed first; their places as ``rank``, if that is given.

    Each task keeps its own first ``cap`` of a key before the exchange, so of a
    key with very many values as many times ``cap`` meet as there are tasks.
    Spark plans that up to a setting, which is raised to ``cap`` if need be.
    """
    conf = counted.sparkSession.conf
    if int(conf.get(_LIMIT, "1000")) < cap:
        conf.set(_LIMIT, str(cap))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first_obs"))
    out = counted.withColumn("_r", place).where(F.col("_r") <= cap)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def _values(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Values with their counts; of each key the first ``cap``, all if that is 0."""
    c = df.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_obs"))
    return first_come(c, keys, cap) if cap else c


def host_counts(o: Observed) -> DataFrame:
    return o.urls.groupBy("host").agg(F.count("*").alias("n"))


def path_length_counts(o: Observed) -> DataFrame:
    return o.urls.groupBy(F.size("iri.path_segments").cast("long").alias("length")).agg(F.count("*").alias("n"))


def raw_shape_counts(o: Observed) -> DataFrame:
    return o.urls.groupBy("raw_shape").agg(F.count("*").alias("n"))


def fingerprint_counts(o: Observed) -> DataFrame:
    return o.urls.groupBy("shape").agg(F.count("*").alias("n"))


POSITION = ["host", "scope", "locator"]
#: A cluster's key and what follows from it.
CLUSTER = ["cluster_key", "host", "scheme", "cluster_shape"]


def position_totals(o: Observed) -> DataFrame:
    return o.segments.groupBy(*POSITION).agg(F.count("*").alias("total"))


def position_values(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    return _values(o.segments, POSITION, cap)


def position_types(o: Observed) -> DataFrame:
    return o.segments.groupBy(*POSITION, "type").agg(F.count("*").alias("n"))


def clusters(o: Observed) -> DataFrame:
    """One row a cluster: host, scheme and shape follow from its key; ord is its first observation.

    So all four are grouped by: a least string would make Spark sort the rows of each task.
    """
    u = o.urls.groupBy("cluster_key", "host", F.col("iri.scheme").alias("scheme"), F.col("cluster_shape").alias("shape"))
    return u.agg(F.count("*").alias("n"), F.min("obs_id").alias("ord"))


def cluster_examples(o: Observed, cap: int = L.EXAMPLE_CAP) -> DataFrame:
    seen = o.urls.groupBy("cluster_key", F.col("iri.canonical").alias("canonical")).agg(F.min("obs_id").alias("first_obs"))
    return first_come(seen, ["cluster_key"], cap)


def cluster_segments(o: Observed) -> DataFrame:
    return o.segments.groupBy("cluster_key", "pos", "value").agg(F.count("*").alias("n"))


PARAM = ["cluster_key", "name"]


def cluster_params(o: Observed) -> DataFrame:
    return o.params.groupBy(*PARAM).agg(F.count("*").alias("total"))


def cluster_param_values(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    return _values(o.params, PARAM, cap)


def cluster_param_types(o: Observed) -> DataFrame:
    return counted_params(o).groupBy(*PARAM, "type").agg(F.sum("n").alias("n"))


def numeric_stats(counted: DataFrame, keys: list[str]) -> DataFrame:
    """count, min, max, sum and avg over the finite values of integer and float types, from the counts of distinct values."""
    number = F.when(F.col("type").isin("integer", "float"), F.col("value").try_cast("double"))
    df = counted.select(*keys, "n", number.alias("x")).where(F.col("x").isNotNull() & (F.abs("x") < float("inf")))
    df = df.groupBy(*keys).agg(F.sum("n").alias("num_count"), F.min("x").alias("num_min"), F.max("x").alias("num_max"), F.sum(F.col("x") * F.col("n")).alias("num_sum"))
    return df.withColumn("num_avg", F.col("num_sum") / F.col("num_count"))


def cluster_param_numeric(o: Observed) -> DataFrame:
    """What is known of a parameter's numbers, in parts that merge."""
    return numeric_stats(counted_params(o), PARAM).drop("num_avg")


def dominant_types(types: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent type of each key; of equals the smallest name."""
    return types.groupBy(*keys).agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("dominant"), F.sum("n").alias("total"))


def segment_stats(o: Observed, cap: int = L.VALUE_CAP) -> DataFrame:
    """Of each position of a cluster: distinct values, whether it is stable (one value), and the ``cap`` most frequent values by count, then name."""
    c = cluster_segments(o)
    sized = c.groupBy("cluster_key", "pos").agg(F.count("*").alias("distinct_values"))
    rank = F.row_number().over(Window.partitionBy("cluster_key", "pos").orderBy(F.desc("n"), "value"))
    top_ = c.withColumn("_r", rank).where(F.col("_r") <= cap)
    listed = top_.groupBy("cluster_key", "pos").agg(F.array_sort(F.collect_list(F.struct("_r", "value"))).alias("l"))
    s = sized.join(listed, ["cluster_key", "pos"])
    return s.select("cluster_key", "pos", "distinct_values", (F.col("distinct_values") == 1).alias("stable"), F.transform("l", lambda x: x["value"]).alias("values"))


def explain_stable(o: Observed) -> DataFrame:
    """(obs_id, pos, value, type, variable) of path segments: none is variable at a position of its cluster that has one value alone."""
    ends = o.segments.groupBy("cluster_key", "pos").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    s = o.segments.join(ends, ["cluster_key", "pos"])
    return s.select("obs_id", "pos", "value", "type", ((F.col("low") < F.col("high")) & (F.col("type") != "literal")).alias("variable"))


def url_list(found: DataFrame) -> DataFrame:
    """(canonical, n) of extracted URLs (line_id, pos, iri): most frequent first, then as first seen."""
    c = found.groupBy(F.col("iri.canonical").alias("canonical")).agg(F.count("*").alias("n"), F.min(F.struct("line_id", "pos")).alias("first"))
    return c.orderBy(F.desc("n"), "first").select("canonical", "n")


def top(counts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys: the report's own limit."""
    return counts.orderBy(F.desc("n"), key).limit(k)


def stats(o: Observed, k: int = 10) -> DataFrame:
    """The report: (section, key, n) of observations, clusters and the k most frequent hosts, shapes and raw shapes."""
    one = [o.urls.agg(F.count("*").alias("n")).select(F.lit("observations").alias("section"), F.lit("").alias("key"), "n"), o.urls.agg(F.count_distinct("cluster_key").alias("n")).select(F.lit("clusters"), F.lit(""), "n")]
    for name, view, key in (("hosts", host_counts, "host"), ("shapes", fingerprint_counts, "shape"), ("raw_shapes", raw_shape_counts, "raw_shape")):
        one.append(top(view(o), key, k).select(F.lit(name), key, "n"))
    out = one[0]
    for part in one[1:]:
        out = out.union(part)
    return out


class Merge(NamedTuple):
    """How rows of a view from two parts of a log become one: the keys of a row, and of which keys the first ``cap`` rows stay (0: all)."""

    keys: list[str]
    of: list[str] = []
    cap: int = 0


#: Numbers of views that add up, and those of which the greatest is taken; of all others it is the least.
SUMS, MOST = ("n", "total", "num_count", "num_sum"), ("num_max",)
MERGES: dict[str, Merge] = {
    "host_counts": Merge(["host"]), "path_length_counts": Merge(["length"]), "raw_shape_counts": Merge(["raw_shape"]), "fingerprint_counts": Merge(["shape"]),
    "position_totals": Merge(POSITION), "position_values": Merge([*POSITION, "value"], POSITION, L.VALUE_CAP), "position_types": Merge([*POSITION, "type"]),
    "clusters": Merge(["cluster_key"]), "cluster_examples": Merge(["cluster_key", "canonical"], ["cluster_key"], L.EXAMPLE_CAP), "cluster_segments": Merge(["cluster_key", "pos", "value"]),
    "cluster_params": Merge(PARAM), "cluster_param_values": Merge([*PARAM, "value"], PARAM, L.VALUE_CAP), "cluster_param_types": Merge([*PARAM, "type"]),
    "cluster_param_numeric": Merge(PARAM),
}


def _sets(df: DataFrame, names: list[str], sets: dict[str, list[str]], *made) -> dict[str, DataFrame]:
    """One aggregation by several sets of keys, kept, and of each set its rows."""
    every = kept(df.groupingSets([[F.col(c) for c in keys] for keys in sets.values()], *names).agg(F.grouping_id().alias("_set"), *made), "sets")
    number = {k: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in keys) for k, keys in sets.items()}
    return {k: every.where(F.col("_set") == number[k]).select(*keys, *(c for c in every.columns if c not in names and c != "_set")) for k, keys in sets.items()}


def all_views(o: Observed, *, capped: bool = True) -> dict[str, DataFrame]:
    """All views from one aggregation of each table of ``o``, by grouping sets; that of numbers from the counts of parameters' values, which are kept. Those of ``capped=False`` have all values, to be merged with others."""
    n, first = F.count("*").alias("n"), F.min("obs_id").alias("first_obs")
    urls = o.urls.select("obs_id", "host", F.size("iri.path_segments").cast("long").alias("length"), "raw_shape", "shape", "cluster_key", F.col("iri.canonical").alias("canonical"), F.col("iri.scheme").alias("scheme"), "cluster_shape")
    u = _sets(urls, ["host", "length", "raw_shape", "shape", "cluster_key", "canonical", "scheme", "cluster_shape"], {"host_counts": ["host"], "path_length_counts": ["length"], "raw_shape_counts": ["raw_shape"], "fingerprint_counts": ["shape"], "clusters": CLUSTER, "cluster_examples": ["cluster_key", "canonical"]}, n, first)
    out = {k: u[k].select(*MERGES[k].keys, "n") for k in ("host_counts", "path_length_counts", "raw_shape_counts", "fingerprint_counts")}
    out["clusters"] = u["clusters"].select("cluster_key", "host", "scheme", F.col("cluster_shape").alias("shape"), "n", F.col("first_obs").alias("ord"))
    out["cluster_examples"] = u["cluster_examples"].select("cluster_key", "canonical", "first_obs")
    # The distinct values of slots are counted once; the sets of coarser keys add them up.
    n, first = F.sum("n").alias("n"), F.min("first_obs").alias("first_obs")
    s = counted(o.segments, [*POSITION, "cluster_key", "pos"])
    s = _sets(s, [*POSITION, "cluster_key", "pos", "value", "type"], {k: MERGES[k].keys for k in ("position_totals", "position_values", "position_types", "cluster_segments")}, n, first)
    c = kept(counted_params(o), "counted")
    out["cluster_param_numeric"] = numeric_stats(c, PARAM).drop("num_avg")
    p = _sets(c, [*PARAM, "value", "type"], {k: MERGES[k].keys for k in ("cluster_params", "cluster_param_values", "cluster_param_types")}, n, first)
    for k, df in {**s, **p}.items():
        total = k in ("position_totals", "cluster_params")
        out[k] = df.select(*MERGES[k].keys, F.col("n").alias("total" if total else "n"), *(["first_obs"] if MERGES[k].cap else []))
    out = {k: first_come(df, MERGES[k].of, MERGES[k].cap) if capped and MERGES[k].cap else df for k, df in out.items()}
    return {k: out[k] if k in out else view(o) for k, view in VIEWS.items()}


def merged_view(name: str, base: DataFrame, later: DataFrame) -> DataFrame:
    """A view of a log from that of its beginning and that, not capped, of what came after.

    What came later is observed later, so a value that the beginning's cap has
    left out stays out, and one that was within keeps its count: the result is
    the view of the whole log, caps included.
    """
    m = MERGES[name]
    made = [(F.sum if c in SUMS else F.max if c in MOST else F.min)(c).alias(c) for c in base.columns if c not in m.keys]
    out = base.unionByName(later).groupBy(*m.keys).agg(*made)
    return first_come(out, m.of, m.cap) if m.cap else out


#: Views by name; add to it to materialise more.
VIEWS: dict[str, Callable[[Observed], DataFrame]] = {
    f.__name__: f
    for f in (host_counts, path_length_counts, raw_shape_counts, fingerprint_counts, position_totals, position_values, position_types, clusters, cluster_examples, cluster_segments, cluster_params, cluster_param_values, cluster_param_types, cluster_param_numeric)
}
