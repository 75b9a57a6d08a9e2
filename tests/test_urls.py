"""Values, URLs, views, inference and the corpus directory on small cases; SQL of all queries in DuckDB at the smallest size."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions import extract, trace, urls, values
from pathloom.operators import infer, learn, render, views
from pathloom.sources.logs import literal_log
from pathloom.sources.store import Corpus

TYPES = {
    "": "literal", "users": "literal", "123": "integer", "1700000000": "timestamp", "1700000000000": "timestamp", "20240115": "date", "20241515": "integer", "2024-99-99": "date",
    "550e8400-e29b-41d4-a716-446655440000": "uuid", "eyJa.bcd.efg": "jwt", "#ff00ff": "color", "a@b.co": "email", "text/html": "mime", "10.0.0.1": "ipv4", "10.0.0.999": "opaque_id",
    "::1": "ipv6", "1.5,2.5": "coordinate", "v1.2": "version", "TRUE": "boolean", "falſe": "boolean", "en-US": "locale", "de": "locale", "qq": "literal", "US": "country", "usd": "currency", "abc": "literal",
    "1.5": "float", "a-b-c": "slug", "report.pdf": "file", "x.unknownx": "opaque_id", "naïve": "literal", "a1b2": "opaque_id", "+1 555 123 4567": "phone", "%23": "literal", "cus_1": "slug",
}


def column(spark, items, f):
    df = spark.createDataFrame(list(enumerate(items)), "i long, v string").coalesce(1)
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_types(spark):
    assert column(spark, list(TYPES), values.classify) == list(TYPES.values())
    assert column(spark, ["cus_1a", "cus_"], lambda v: values.classify(v, [("cus_", "cus")])) == ["cus", "literal"]


def test_values(spark):
    words = {"users": "user", "People": "Person", "CHILDREN": "CHILD", "statuses": "status", "news": "news", "queries": "query", "x": "x", "": ""}
    assert column(spark, list(words), values.singularize) == list(words.values())
    dates = {"2024/01/15": "2024-01-15", "1/5/2024": "2024-01-05", "20240115": "2024-01-15", "2024-13-01": None, "x": None}
    assert column(spark, list(dates), values.canonical_date) == list(dates.values())
    hosts = {"a.b.co.uk": "b.co.uk", "a.b.example.com": "example.com", "10.0.0.1": "10.0.0.1", "localhost": "localhost", "": ""}
    assert column(spark, list(hosts), values.registrable_domain) == list(hosts.values())


URLS = {
    "https://foo.com:443/users/123/?b=2&a=1&b=3#x": ("https://foo.com/users/123?b=2&a=1&b=3#x", "https://foo.com/users/{user_id}?a={integer}&b={integer}"),
    "HTTP://FOO.com:8080/a/./b/../c?flag": ("http://foo.com:8080/a/c?flag", "http://foo.com:8080/a/c?flag="),
    "foo.com": ("https://foo.com", "https://foo.com/"),
    "urn:isbn:12345": ("urn:isbn:12345", "urn:isbn:{isbn_id}"),
    "mailto:a@b.c": ("mailto:a@b.c", "mailto:a@b.c"),
    "https://x.com/d/1/5/2024/usd?cur=eur&email=me": ("https://x.com/d/1/5/2024/usd?cur=eur&email=me", "https://x.com/d/{d_id}/{integer}/{integer}/USD?cur=EUR&email={email}"),
    "": (None, None), "nothing": (None, None), "urn:": (None, None), "https://a.b:99999999999999999999/": (None, None),
}


def test_urls(spark):
    log = literal_log(spark, list(URLS)).coalesce(1)
    got = [(r.c, r.normalized) for r in urls.normalize_urls(urls.parse_urls(log).withColumn("c", F.col("iri.canonical"))).orderBy("obs_id").collect()]
    assert got == list(URLS.values())
    again = urls.parse_urls(urls.parse_urls(log).select(F.col("iri.canonical").alias("url")).where("url is not null"))
    assert again.where("iri.canonical <> url or iri.error is not null").count() == 0
    assert urls.parse_urls(spark.createDataFrame([(None,)], "url string")).first().iri.error == "input is empty"


def test_trace_and_extract(spark):
    t = trace.trace_urls(literal_log(spark, ["https://s.com/p/usd?d=2024/1/05&d=1/5/2024"])).first().trace
    assert [p.notes for p in t.path][1] == ["currency upcase (usd → USD)"] and t.query[0].notes == ["canonical date (1/5/2024 → 2024-01-05)"]
    text = spark.createDataFrame([(1, "See (https://a.com/x(1)). and b.org/y, urn:isbn:1; not@foo.com/z https://a.com/x(1)"), (2, None)], "id long, text string")
    assert [r.urls for r in extract.extract_strings(text).collect()] == [["https://a.com/x(1)", "https://b.org/y", "urn:isbn:1"]]


def observed(spark, items):
    return views.observe(literal_log(spark, items), keep=True)


def test_views_and_inference(spark):
    items = [f"https://api.com/users/{k}/orders/{k}?state={s}&year={1990 + k}" for k, s in enumerate(["open", "shut", "open"] * 10)]
    o = observed(spark, [*items, "not a url", "urn:a:1"])
    assert dict(views.host_counts(o).collect()) == {"api.com": 30, "": 1}
    summary = {r.name: r for r in infer.param_summary(o).collect()}
    assert summary["state"].type == "enum" and summary["state"].confidence == 0.67 and summary["state"].presence <= 1
    assert views.position_values(o, 2).where("locator = '/users'").count() == 2
    normal = {r.normalized for r in render.corpus_normalize(o, o).collect()}
    assert all("/users/" in n for n in normal if n.startswith("https"))
    # The running form of the last URL is its form by the final state.
    last = o.urls.agg(F.max("obs_id")).first()[0]
    final = dict(render.corpus_normalize(o, o).collect())
    assert dict(render.running_normalize(o).collect())[last] == final[last]


def test_inferred_literal_slot(spark):
    names = "alice bob carol dave erin frank gina hank ivan jane".split()
    o = observed(spark, [f"https://foo.com/users/{n}/profile" for n in names])
    ask = views.observe(literal_log(spark, ["https://foo.com/users/zoe/profile"]))
    assert render.corpus_normalize(o, ask, hints=False).first().normalized == "https://foo.com/users/{value}/profile"
    assert render.corpus_normalize(o, ask).first().normalized == "https://foo.com/users/{user}/profile"


def test_learning_and_store(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    log = literal_log(spark, [f"https://h{k % 2}.com/customers/cus_{k}a" for k in range(60)])
    c.append(log, 0)
    c.append(log, 0)
    assert c.log().count() == 60 and c.log(after=50).count() == 10
    assert c.reinfer() == 1 and c.view("clusters").count() == 2
    p = learn.proposals(c.observed()).first()
    assert (p.prefix, p.type, p.matching, p.hosts) == ("cus_", "cus", 60, 2)
    assert c.activate_above(0.9) == [("cus_", "cus")] and c.version() == 2
    assert {r.shape for r in c.view("fingerprint_counts").collect()} == {"/customers/{cus}"}
    shared = learn.cross_host_shapes(c.observed()).first()
    assert (shared.shape, shared.n_hosts, shared.observations) == ("/customers/{cus}", 2, 60)
    c.save_json(f"{tmp_path}/corpus.json")
    two = views.merged_view("host_counts", c.view("host_counts"), c.view("host_counts"))
    assert dict(two.collect()) == {"h0.com": 60, "h1.com": 60}
    c.reset()
    assert c.version() == 0


def test_stream(spark, tmp_path):
    from pathloom.streaming.stream import normalize_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("see https://a.com/users/1 now\nand https://a.com/users/2\n")
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    q = normalize_stream(spark.readStream.text(f"{tmp_path}/in"), c, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.normalized for r in got} == {"https://a.com/users/{user_id}"} and len(got) == 2


def test_empty_log(spark):
    o = observed(spark, ["nothing"])
    assert all(v(o).count() == 0 for v in (views.host_counts, views.position_values, views.clusters, infer.param_summary))


@pytest.mark.parametrize("name", ["routes", "parse_fields", "normalize", "segment_stats", "param_summary", "proposals"])
def test_sql_agrees(spark, name):
    import os

    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    df = entry.queries()[name](spark, d)
    c = con.execute(entry.oracle_sql()[name])
    own = [x[0] for x in c.description]
    assert sorted(own) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[k] for k in own) for r in df.collect()))) == sorted(map(repr, c.fetchall()))


def whole(spark, name):
    """Rows of a query at the smallest size, which its SQL must give too."""
    test_sql_agrees(spark, name)
    import __spark_entry__ as entry

    return entry.queries()[name](spark, "/root/testdata/sf0.001").collect()


def test_params_for_log(spark):
    keys = {r.cluster_key for r in whole(spark, "params_for_log")}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    asked = events.selectExpr("concat('https://', if(event_id % 2 = 1, 'api', 'www'), '.example.net/', event_type, '/')").distinct()
    assert {k[: k.rindex("/") + 1] for k in keys} == {r[0] for r in asked.collect()}
    assert any("//api." in k for k in keys) and any("//www." in k for k in keys)


def test_values_up_to_the_default_cap(spark):
    counted = {}
    for name, keys in (("position_values", ("host", "scope", "locator")), ("cluster_param_values_full", ("cluster_key", "name"))):
        rows = whole(spark, name)
        counted[name] = {}
        for r in rows:
            slot = tuple(r[k] for k in keys)
            counted[name][slot] = counted[name].get(slot, 0) + 1
    assert 100 < max(counted["position_values"].values()) <= 5000


def test_cli_prints_all_rows(spark, tmp_path, capsys):
    from pathloom import cli

    (tmp_path / "a.txt").write_text("".join(f"https://a.com/users/{k}\n" for k in range(1200)))
    cli.main(["normalize", f"{tmp_path}/a.txt"])
    assert capsys.readouterr().out.count("\thttps://a.com/users/{user_id}") == 1200
