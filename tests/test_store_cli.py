"""Numbering, corpora in directories and files, reports, SQL functions and the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from pathloom import cli
from pathloom.functions import sql
from pathloom.functions.extract import extract_urls
from pathloom.functions.urls import parse_urls
from pathloom.functions.values import classify
from pathloom.operators import report, views
from pathloom.sources import logs, store
from pathloom.sources.tables import discard, kept, numbered

URLS = ["https://foo.com/users/1", "https://foo.com/users/2", "https://foo.com/users/3?a=1", "https://foo.com/posts/abc-123", "https://bar.com/x", "urn:isbn:123"]


def test_numbers_follow_files_and_lines(spark, tmp_path):
    for name, n in (("b.txt", 300), ("a.txt", 5), ("c.txt", 40)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    got = [(r.line_id, r.text) for r in logs.text_file(spark, str(tmp_path)).orderBy("line_id").collect()]
    assert got == list(enumerate([f"{n} {i}" for n, k in (("a.txt", 5), ("b.txt", 300), ("c.txt", 40)) for i in range(k)], 1))
    whole = [(r.line_id, r.text[:5]) for r in logs.text_file(spark, str(tmp_path), whole=True).orderBy("line_id").collect()]
    assert whole == [(1, "a.txt"), (2, "b.txt"), (3, "c.txt")]
    n = numbered(spark.range(1000).repartition(7), "k", 5)
    assert sorted(r.k for r in n.collect()) == list(range(5, 1005))


def test_kept_tables_can_be_discarded(spark):
    t = kept(spark.range(5), "five")
    assert t.count() == 5
    discard(t, t)
    with pytest.raises(Exception, match="PATH|exist"):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_versions_and_json(spark, tmp_path):
    c = store.Corpus(spark, str(tmp_path / "corpus"))
    assert c.version() == 0
    c.append(logs.literal_log(spark, URLS), 0)
    for k in (1, 2, 3):
        assert c.reinfer() == k == c.version()
    assert {r.host: r.n for r in c.view("host_counts").collect()} == {"foo.com": 4, "bar.com": 1, "": 1}
    assert len(list((tmp_path / "corpus/views").iterdir())) == 2 == len(list((tmp_path / "corpus/current").glob("0*")))
    file = str(tmp_path / "c.json")
    c.save_json(file)
    made = json.loads((tmp_path / "c.json").read_text())
    assert list(made) == ["host_counts", "path_length_counts", "raw_shape_counts", "fingerprint_counts", "max_values_per_position", "position_stats", "clusterer", "observed_iris", "activated_recognizers"]
    assert made["observed_iris"] == URLS and made["fingerprint_counts"]["/users/{user_id}"] == 3
    users = made["clusterer"]["clusters"]["https://foo.com/users/{user_id}"]
    assert users["count"] == 3 and users["examples"] == URLS[:3] and users["segment_counts"] == [{"users": 3}, {"1": 1, "2": 1, "3": 1}]
    assert users["param_stats"]["a"]["value_counts"] == {"1": 1}
    at = next(x for x in made["position_stats"] if x["position"]["locator"] == "/users")["stats"]
    assert at["type_counts"] == {"integer": 3} and (at["numeric_min"], at["numeric_max"], at["numeric_sum"]) == (1.0, 3.0, 6.0)
    again = store.open_corpus(spark, file)
    assert [r.url for r in again.log().orderBy("obs_id").collect()] == URLS
    again.append(logs.literal_log(spark, ["https://new.com/"]))
    again.close()
    assert json.loads((tmp_path / "c.json").read_text())["host_counts"]["new.com"] == 1
    assert [p.name for p in tmp_path.glob("c.json*")] == ["c.json"]


def test_paths_of_corpora(monkeypatch):
    for name in ("PATHLOOM_CORPUS", "PATHLOOM_NO_CORPUS"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("XDG_DATA_HOME", "/data")
    assert store.corpus_path() == "/data/pathloom/default"
    monkeypatch.setenv("PATHLOOM_CORPUS", "/c")
    assert store.corpus_path() == "/c" and store.corpus_path("/d", without=True) == "/d" and store.corpus_path(without=True) is None
    monkeypatch.setenv("PATHLOOM_NO_CORPUS", "yes")
    assert store.corpus_path() is None


def test_number_text(spark):
    cases = {3.0: "3", -0.0: "0", 2.5: "2.5", 1.005: "1.0", 2.346: "2.35", 1e15: "1000000000000000", -7.25: "-7.25"}
    df = spark.createDataFrame([(k,) for k in cases], "x double").select("x", report.number_text(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == cases


def test_reports(spark):
    o = views.observe(logs.literal_log(spark, [f"https://foo.com/users/{i}?page={i}" for i in range(1, 6)]))
    text = report.cluster_lines(o).first().text.split("\n")
    assert text[0] == "[5] foo.com  /users/{user_id}" and text[1:4] == [f"    https://foo.com/users/{i}?page={i}" for i in (1, 2, 3)] and text[4] == "    + 2 more"
    assert text[5] == "    page  integer  conf 0.25  1..5  avg 3  (5 distinct, 100%)"
    made = json.loads(report.cluster_json(o).first().json)
    assert made["count"] == 5 and made["segments"][0] == {"position": 0, "stable": True, "values": {"users": 5}}
    assert {k: made["params"][0][k] for k in ("name", "type", "min", "max", "avg")} == {"name": "page", "type": "integer", "min": 1.0, "max": 5.0, "avg": 3.0}
    assert {r.pos: r.variable for r in views.explain_stable(o).collect()} == {0: False, 1: True}


def test_sql_functions(spark):
    assert "url_value_type" in sql.register(spark)
    r = spark.sql("select url_value_type('2024-01-02') t, url_singular('categories') s, url_param_type('email', 'bob') p, url_registrable_domain('a.b.co.uk') d, url_host('HTTPS://Foo.com:80/x') h, url_value_type(null) n").first()
    assert tuple(r) == ("date", "category", "email", "b.co.uk", "foo.com", None)
    texts = ["HTTPS://Foo.com:443/a/../b?x&x=1&x=2#y", "see foo.com/users/7, then (http://a.com/x_(y)).", "urn:isbn:1", "no url", "", None, "'\"\\"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = spark.sql("SELECT k, url_canonical(t) c FROM {df}", df=df)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, parse_urls(df, "t").select("k", F.col("iri.canonical").alias("c")).collect()))
    got = spark.sql("SELECT k, p.* FROM {df}, LATERAL url_parts(t) p", df=df)
    want = parse_urls(df, "t").select("k", "iri.*").drop("original").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    got = spark.sql("SELECT k, f.pos, f.url FROM {df}, LATERAL url_found(t) f", df=df)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in extract_urls(df, "t").select("k", "pos", "iri.canonical").collect())


def test_recognizers_by_predicate(spark):
    own = [(lambda v: v.endswith("-order"), "order_no"), ("tok_", "tok")]
    df = spark.createDataFrame([("abc-order",), ("tok_9",), ("users",)], "v string").select(classify(F.col("v"), own).alias("t"))
    assert [r.t for r in df.collect()] == ["order_no", "tok", "literal"]


def run(spark, *args):
    return "\n".join(cli.lines(spark, cli.parser().parse_args([*args]))).split("\n")


def test_command_line(spark, tmp_path, monkeypatch):
    assert run(spark, "-C", "-n", "https://foo.com/users/123") == ["https://foo.com/users/{user_id}"]
    assert run(spark, "-C", "-c", "HTTPS://Foo.com:443/a") == ["https://foo.com/a"]
    assert json.loads("".join(run(spark, "-C", "-jp", "https://foo.com/a?x"))) == {"original": "https://foo.com/a?x", "kind": "url", "scheme": "https", "host": "foo.com", "path_segments": ["a"], "query_params": {"x": None}, "canonical": "https://foo.com/a?x"}
    text = tmp_path / "t.txt"
    text.write_text("see https://a.com/1 and https://a.com/2\nhttps://a.com/1\n")
    assert run(spark, "-C", str(text)) == ["[2] https://a.com/1", "[1] https://a.com/2"]
    assert run(spark, "-C", "-n", str(text)) == ["https://a.com/{integer}"] * 3
    assert [json.loads(x) for x in run(spark, "-C", "-nJ", str(text))] == ["https://a.com/{integer}"] * 3
    assert json.loads("".join(run(spark, "-C", "-j", str(text)))) == [{"iri": "https://a.com/1", "count": 2}, {"iri": "https://a.com/2", "count": 1}]
    assert run(spark, "-C", "cluster", str(text))[0] == "[3] a.com  /{integer}"
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("\n".join(f"https://b.com/u/{i}" for i in range(12)).encode())))
    assert run(spark, "-C")[0] == "[12] b.com  /u/{u_id}"
    corpus = str(tmp_path / "kept")
    assert run(spark, "--corpus", corpus, str(text))[0] == "[2] https://a.com/1"
    assert run(spark, "--corpus", corpus, "--stats")[0] == "observations: 3"
    assert run(spark, "--corpus", corpus, "--reinfer") == ["reinferred 3 observations: 1 → 1 cluster"]
    assert run(spark, "--corpus", corpus, "--propose-recognizers") == ["no recognizer proposals (3 observations scanned)"]
    assert run(spark, "--corpus", corpus, "--cross-host-shapes") == ["no cross-host shapes (1 cluster scanned)"]
    assert run(spark, "--corpus", corpus, "--reset") == [f"reset corpus at {corpus}"]
    assert not (tmp_path / "kept").exists()
