"""One query for each operator, over the provided tables and the logs derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, sql, trace, urls, values
from ..functions import lexicon as L
from ..operators import infer, learn, render, running, views
from ..sources import logs
from ..sources.store import Corpus
from ..sources.tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and URNs in one log: pages have even numbers here."""
    pages = logs.log_pages(spark, sf_dir).select((F.col("obs_id") * 4).alias("obs_id"), "url")
    return pages.union(logs.log_urns(spark, sf_dir).select((F.col("obs_id") * 4 + 1).alias("obs_id"), "url"))


def _observed(log: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str, **options) -> views.Observed:
    return views.observe(log(spark, sf_dir), **options)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What routes does this service expose? Host, shape and count of the page log."""
    u = views.observed_urls(logs.log_pages(spark, sf_dir))
    return u.groupBy("host", "shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host", "shape")


query(routes)


# Scalar functions ---------------------------------------------------------------------------------------------------


@query
def parse_fields(spark, d):
    broken = logs.log_broken(spark, d).select((F.col("obs_id") * 4 + 2).alias("obs_id"), "url")
    p = urls.parse_urls(_mixed(spark, d).union(broken))
    return p.select("obs_id", "iri.kind", "iri.scheme", "iri.host", "iri.port", F.size("iri.path_segments").cast("long").alias("n_segments"), "iri.fragment", "iri.nss", "iri.error")


@query
def canonical(spark, d):
    return urls.parse_urls(_mixed(spark, d)).select("obs_id", "iri.canonical")


@query
def distinct_identifiers(spark, d):
    """Identity is equality of canonical forms."""
    return urls.parse_urls(_mixed(spark, d)).groupBy("iri.canonical").agg(F.count("*").alias("n"))


@query
def path_segments(spark, d):
    p = urls.parse_urls(logs.log_pages(spark, d))
    return p.select("obs_id", F.posexplode("iri.path_segments").alias("pos", "value"))


@query
def query_params(spark, d):
    p = urls.parse_urls(logs.log_pages(spark, d).select((F.col("obs_id") * 2).alias("obs_id"), "url").union(logs.log_repeats(spark, d).select((F.col("obs_id") * 2 + 1).alias("obs_id"), "url")))
    return p.select("obs_id", F.explode("iri.params").alias("p")).select("obs_id", "p.name", "p.value")


def _some_values(spark, d):
    o = [_observed(x, spark, d).segments.select("value") for x in (logs.log_pages, logs.log_orders, logs.log_customers)]
    return o[0].union(o[1]).union(o[2]).distinct()


@query
def classify_segments(spark, d):
    v = _some_values(spark, d).withColumn("type", values.classify(F.col("value")))
    return v.select("value", "type", (F.col("type") != "literal").alias("variable"), values.display_type(F.col("type")).alias("display"))


@query
def classify_params(spark, d):
    v = _observed(logs.log_events, spark, d).params.select("name", "value", "type").union(_observed(logs.log_pages, spark, d).params.select("name", "value", "type")).distinct()
    return v.withColumn("hint", values.param_name_hint(F.col("name"), F.col("type")))


@query
def file_kind(spark, d):
    v = _observed(logs.log_pages, spark, d).segments.where("type = 'file'").select("value").distinct()
    return v.withColumn("kind", values.file_kind(F.col("value")))


_DATES = "case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'yyyy/MM/dd') when 2 then date_format(o_orderdate, 'M/d/yyyy') when 3 then date_format(o_orderdate, 'yyyyMMdd') else concat('2024-', 10 + o_orderkey % 9, '-', 20 + o_orderkey % 17) end"


@query
def canonical_date(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"{_DATES} as value")
    return o.select("o_orderkey", "value", values.canonical_date(F.col("value")).alias("canonical"))


@query
def canonical_currency(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "element_at(array('usd', 'EUR', 'abc', 'Jpy', 'euros'), cast(p_partkey % 5 + 1 as int)) as value")
    return p.select("p_partkey", "value", values.canonical_currency(F.col("value")).alias("canonical"))


@query
def registrable_domain(spark, d):
    h = urls.parse_urls(logs.log_pages(spark, d)).select("iri.host").distinct()
    h = h.union(spark.createDataFrame([(x,) for x in HOSTS], "host string"))
    return h.select("host", values.registrable_domain(F.col("host")).alias("registrable"))


#: Hosts and words that the tables lack.
HOSTS = ["a.b.co.uk", "shop.example.com.au", "co.uk", "localhost", "10.0.0.1", "x.y.z.example.org", "muni.il", "a.muni.il", "b.a.muni.il"]
WORDS = "users people children boxes buses statuses queries categories leaves wolves knives analyses theses news series shoes movies mice oxen quizzes matrices data octopi crises heroes photos glass addresses cats sheep tomatoes hives archives olives".split()


@query
def singularize(spark, d):
    w = spark.createDataFrame([(x,) for x in WORDS], "word string")
    w = w.union(_observed(logs.log_events, spark, d).segments.where("type = 'literal'").select("value").distinct())
    return w.distinct().select("word", values.singularize(F.col("word")).alias("singular"))


@query
def hinted_shape(spark, d):
    return _observed(logs.log_orders, spark, d).urls.select("obs_id", "shape", "cluster_key")


@query
def raw_shape(spark, d):
    return _observed(logs.log_orders, spark, d).urls.select("obs_id", "raw_shape")


@query
def locators(spark, d):
    return _observed(logs.log_orders, spark, d).segments.select("obs_id", "pos", "locator")


@query
def normalize(spark, d):
    return urls.normalize_urls(logs.log_orders(spark, d)).select("obs_id", "normalized")


@query
def normalize_nohints(spark, d):
    return urls.normalize_urls(logs.log_events(spark, d), hints=False).select("obs_id", "normalized")


@query
def normalize_urn(spark, d):
    return urls.normalize_urls(logs.log_urns(spark, d)).select("obs_id", "normalized")


@query
def explain(spark, d):
    return trace.explain_urls(logs.log_events(spark, d)).select("obs_id", "pos", "value", "type", "variable", "hint")


@query
def trace_notes(spark, d):
    """Notes of the normal forms of dates and of names that lift parameter types."""
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey obs_id", f"concat('https://api.example.com/orders/', o_orderkey, '?date=', {_DATES}, '&email=nobody&cur=', if(o_orderkey % 2 = 0, 'usd', 'EUR')) url")
    t = trace.trace_urls(o)
    q = t.select("obs_id", F.explode("trace.query").alias("q")).select("obs_id", "q.name", "q.type", "q.output", F.explode("q.notes").alias("note"))
    return q


@query
def trace_evidence(spark, d):
    t = trace.trace_urls(logs.log_orders(spark, d)).select("obs_id", F.explode("trace.evidence").alias("e"))
    return t.select("obs_id", "e.subject_kind", "e.subject", "e.source", F.element_at("e.payload", "type").alias("type")).where("source = 'classifier'")


@query
def extract_urls(spark, d):
    return extract.extract_urls(logs.text_odd(spark, d)).select("page_id", "pos", "iri.canonical")


@query
def extract_strings(spark, d):
    return extract.extract_strings(logs.text_odd(spark, d)).select("page_id", F.array_join("urls", " ").alias("urls"))


@query
def url_list(spark, d):
    return views.url_list(extract.extract_urls(logs.text_odd(spark, d)).withColumnRenamed("page_id", "line_id"))


# Views --------------------------------------------------------------------------------------------------------------


@query
def host_counts(spark, d):
    return views.host_counts(_observed(_mixed, spark, d))


@query
def path_length_counts(spark, d):
    return views.path_length_counts(_observed(_mixed, spark, d))


@query
def raw_shape_counts(spark, d):
    return views.raw_shape_counts(_observed(_mixed, spark, d))


@query
def fingerprint_counts(spark, d):
    return views.fingerprint_counts(_observed(logs.log_lineitem, spark, d))


@query
def position_totals(spark, d):
    return views.position_totals(_observed(logs.log_events, spark, d))


def _parts(log, n: int) -> list[DataFrame]:
    """A log in ``n`` parts, by obs_id."""
    ends = log.agg(F.min("obs_id").alias("low"), F.max("obs_id").alias("high")).first()
    wide = (ends["high"] - ends["low"]) // n + 1
    return [log.where(F.floor((F.col("obs_id") - ends["low"]) / wide) == k) for k in range(n)]


@query
def position_values_capped(spark, d):
    """Merged from the view of the log's first half and what came after."""
    first, later = (views.observe(part) for part in _parts(logs.log_orders(spark, d), 2))
    return views.merged_view("position_values", views.position_values(first), views.position_values(later, 0))


@query
def position_values(spark, d):
    """With the cap of the operator."""
    return views.position_values(_observed(logs.log_orders, spark, d))


@query
def position_types(spark, d):
    return views.position_types(_observed(logs.log_customers, spark, d))


@query
def dominant_type(spark, d):
    return views.dominant_types(views.position_types(_observed(logs.log_customers, spark, d)), views.POSITION)


@query
def clusters(spark, d):
    return views.clusters(_observed(_mixed, spark, d))


@query
def cluster_examples(spark, d):
    return views.cluster_examples(_observed(logs.log_events, spark, d))


@query
def cluster_segments(spark, d):
    return views.cluster_segments(_observed(logs.log_pages, spark, d))


@query
def segment_stats(spark, d):
    return views.segment_stats(_observed(logs.log_pages, spark, d)).withColumn("values", F.array_join("values", ","))


@query
def explain_stability(spark, d):
    return views.explain_stable(_observed(logs.log_pages, spark, d))


@query
def cluster_params(spark, d):
    return views.cluster_params(_observed(logs.log_lineitem, spark, d))


@query
def cluster_param_values(spark, d):
    return views.cluster_param_values(_observed(logs.log_events, spark, d), L.VALUE_CAP)


@query
def cluster_param_values_full(spark, d):
    """From the one aggregation that gives all views of parameters."""
    return views.all_views(_observed(logs.log_events, spark, d, keep=True))["cluster_param_values"]


@query
def cluster_param_types(spark, d):
    return views.cluster_param_types(_observed(logs.log_lineitem, spark, d))


@query
def param_numeric(spark, d):
    n = views.numeric_stats(views.counted_params(_observed(logs.log_lineitem, spark, d)), views.PARAM)
    return n.select(*views.PARAM, "num_count", "num_min", "num_max", infer.rounded(F.col("num_avg"), 4).alias("num_avg"))


@query
def stats_top10(spark, d):
    return views.stats(_observed(_mixed, spark, d, keep=True))


# Inference ----------------------------------------------------------------------------------------------------------


@query
def param_type_ladder(spark, d):
    s = [infer.param_stats(_observed(x, spark, d)).select("cluster_key", "name", "total", "cardinality", infer.ladder(F.col("name")).alias("type")) for x in (logs.log_events, logs.log_lineitem, logs.log_orders)]
    return s[0].union(s[1]).union(s[2])


@query
def param_summary(spark, d):
    s = infer.param_summary(_observed(logs.log_events, spark, d))
    return s.withColumn("presence", infer.rounded(F.col("presence"), 4)).withColumn("num_avg", infer.rounded(F.col("num_avg"), 4))


@query
def enum_members(spark, d):
    return infer.enum_members(_observed(logs.log_lineitem, spark, d)).withColumn("members", F.array_join("members", ","))


@query
def value_distribution(spark, d):
    return infer.value_distribution(_observed(logs.log_lineitem, spark, d))


@query
def subtype_distribution(spark, d):
    return infer.subtype_distribution(_observed(logs.log_lineitem, spark, d))


@query
def kind_distribution(spark, d):
    log = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey obs_id", "concat('https://files.example.com/get?name=doc', p_partkey, element_at(array('.pdf', '.png', '.csv', '.zip'), cast(p_partkey % 4 + 1 as int))) url")
    return infer.kind_distribution(views.observe(log))


@query
def params_for(spark, d):
    o = _observed(logs.log_events, spark, d, keep=True)
    return infer.params_for(o, o.urls).select("cluster_key", "name", "type", "total", "cardinality", "confidence")


@query
def params_for_log(spark, d):
    """As ``params_for``, for the URLs of another table of the same log."""
    o = _observed(logs.log_events, spark, d, keep=True)
    return infer.params_for(o, _observed(logs.log_events, spark, d).urls).select("cluster_key", "name", "type", "total", "cardinality", "confidence")


@query
def cluster_assembly(spark, d):
    a = infer.assembled(_observed(logs.log_pages, spark, d, keep=True))
    return a.select("cluster_key", "n", "ord", F.array_join(F.transform("examples", lambda x: x["canonical"]), " ").alias("examples"), F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["pos"].cast("string"), F.array_join(s["values"], ","))), " ").alias("segments"), F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type"])), " ").alias("params"))


@query
def corpus_explain(spark, d):
    o = _observed(logs.log_orders, spark, d, keep=True)
    return render.corpus_explain(o, o)


@query
def corpus_normalize(spark, d):
    log = logs.log_orders(spark, d).union(logs.log_workspaces(spark, d).selectExpr("obs_id + 1000000000 obs_id", "url"))
    o = views.observe(log, keep=True)
    return render.corpus_normalize(o, o)


@query
def running_normalize(spark, d):
    return render.running_normalize(_observed(logs.log_orders, spark, d, keep=True))


@query
def running_normalize_carried(spark, d):
    """As ``running_normalize``, in three batches, each from the state that the one before has left."""
    out, state = None, None
    for part in _parts(logs.log_orders(spark, d), 3):
        done, touched = render.carried_normalize(views.observe(part, keep=True), state)
        state = running.kept_state(running.merged_state(state, touched))
        out = done if out is None else out.union(done)
    return out


@query
def merged_views(spark, d):
    """(view, n_rows, total) of all views of the event log, merged from those of its first two thirds and of the rest."""
    first, second, later = _parts(logs.log_events(spark, d), 3)
    base = views.all_views(views.observe(first.union(second), keep=True))
    more = views.all_views(views.observe(later, keep=True), capped=False)
    out = None
    for name in base:
        v = views.merged_view(name, base[name], more[name])
        number = next(c for c in ("n", "total", "num_count", "first_obs") if c in v.columns)
        one = v.agg(F.lit(name).alias("view"), F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).alias("total"))
        out = one if out is None else out.union(one)
    return out


def _corpus(spark, log: DataFrame, parts: int = 2) -> Corpus:
    """A corpus in the shared folder that a log has been appended to in parts."""
    c = Corpus(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")
    for part in _parts(log, parts):
        c.append(part)
    return c


@query
def corpus_log(spark, d):
    """(obs_id, url) of a log as a corpus gives it back after three appends: numbered without gaps, without what can't be parsed."""
    log = logs.log_pages(spark, d).select((F.col("obs_id") * 2).alias("obs_id"), "url").union(logs.log_broken(spark, d).select((F.col("obs_id") * 2 + 1).alias("obs_id"), "url"))
    return _corpus(spark, log, 3).log()


@query
def corpus_views(spark, d):
    """A view of a corpus that was brought up to date after each of two appends."""
    c = Corpus(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")
    for part in _parts(logs.log_events(spark, d), 2):
        c.append(part)
        c.refresh()
    return c.view("cluster_segments")


@query
def corpus_lookup(spark, d):
    """Normal forms of all page URLs by the stored evidence of the corpus that they make up."""
    c = _corpus(spark, logs.log_orders(spark, d))
    upto = c.last_commit().number
    o = c.observed(upto=upto)
    c.reinfer(o, upto)
    # What was parsed are the canonical forms that the log has.
    return c.normalized(o).join(o.urls.select("obs_id", F.col("iri.original").alias("url")), "obs_id").select("url", "normalized")


@query
def sql_segments(spark, d):
    """Segments and parameters of the page log in SQL text alone."""
    sql.register(spark)
    return spark.sql("SELECT l.obs_id, s.pos, CAST(NULL AS STRING) AS name, s.value, s.type FROM {log} l, LATERAL url_segments(l.url) s UNION ALL SELECT l.obs_id, NULL, p.name, p.value, p.type FROM {log} l, LATERAL url_params(l.url) p", log=logs.log_pages(spark, d))


@query
def sql_extraction(spark, d):
    """URLs of odd texts in SQL text alone."""
    sql.register(spark)
    return spark.sql("SELECT t.page_id, f.pos, f.url AS canonical FROM {texts} t, LATERAL url_found(t.text) f", texts=logs.text_odd(spark, d))


@query
def sql_parts(spark, d):
    """Canonical forms and failures in SQL text alone."""
    sql.register(spark)
    broken = logs.log_broken(spark, d).select((F.col("obs_id") * 4 + 2).alias("obs_id"), "url")
    hosts = logs.log_hosts(spark, d).select((F.col("obs_id") * 4 + 3).alias("obs_id"), "url")
    return spark.sql("SELECT l.obs_id, p.kind, p.scheme, p.host, p.port, p.canonical, p.error FROM {log} l, LATERAL url_parts(l.url) p", log=_mixed(spark, d).union(broken).union(hosts))


@query
def hosts_and_ports(spark, d):
    """Hosts in lower case, whatever their script; ports that are the scheme's own go; white space around a URL too."""
    p = urls.parse_urls(logs.log_hosts(spark, d))
    return p.select("obs_id", "iri.scheme", "iri.host", "iri.port", "iri.canonical")


# Learning -----------------------------------------------------------------------------------------------------------


@query
def proposals(spark, d):
    p = learn.proposals(_observed(logs.log_customers, spark, d))
    return p.withColumn("samples", F.array_join("samples", ",")).withColumn("coverage", infer.rounded(F.col("coverage"), 4)).withColumn("confidence", infer.rounded(F.col("confidence"), 4))


@query
def activate_reinfer(spark, d):
    _, o = learn.activate_above(logs.log_customers(spark, d), 0.9)
    return views.fingerprint_counts(o)


@query
def cross_host_shapes(spark, d):
    return learn.cross_host_shapes(_observed(logs.log_events, spark, d)).withColumn("hosts", F.array_join("hosts", ","))


@query
def host_strategy_registrable(spark, d):
    return views.clusters(_observed(logs.log_events, spark, d, strategy="registrable"))


@query
def host_strategy_none(spark, d):
    return views.clusters(_observed(logs.log_pages, spark, d, strategy="none"))


@query
def union_of_logs(spark, d):
    both = logs.union_logs(logs.log_pages(spark, d), logs.log_orders(spark, d))
    return views.host_counts(views.observe(both))
