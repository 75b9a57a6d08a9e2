"""Commits by several writers, views that are merged, and running evidence that is carried on."""

import io
import json
import os
import random
import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from pathloom import cli
from pathloom.operators import render, running, views
from pathloom.sources.files import Folder
from pathloom.sources.logs import literal_log
from pathloom.sources.store import Corpus, open_corpus
from pathloom.sources.tables import ranked

WORDS = "alice bob carol dave erin frank gina hank ivan jane kim lee".split()


def some_urls(n, seed):
    r = random.Random(seed)
    kinds = [
        lambda: f"https://a.com/users/{r.choice(WORDS)}/profile?page={r.randint(1, 9)}",
        lambda: f"https://a.com/users/{r.randint(1, 40)}?status={r.choice(['open', 'shut'])}&code={r.choice([200, 301, 404])}",
        lambda: f"https://b.org/{r.choice(['x', 'y'])}/{r.choice(WORDS)}-{r.choice(WORDS)}/{2000 + r.randint(0, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}?v={r.choice(['1', '2.5', 'on', '2024-01-02', ''])}",
        lambda: f"urn:isbn:{r.randint(1, 30)}",
        lambda: f"https://c.net/{r.choice(WORDS)}",
    ]
    return [r.choice(kinds)() for _ in range(n)]


def rows(df):
    return sorted(map(repr, df.collect()))


def test_numbers_of_any_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    out, n, _ = ranked(df, "n", "k", first=5)
    assert n == 5000 and [r.n for r in out.orderBy("k").select("n").collect()] == list(range(5, 5005))
    assert ranked(df.limit(0), "n", "k")[1] == 0


def test_files_are_created_once(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "f"))
    assert f.names() == [] and f.create("one", "x", "1") and not f.create("two", "x", "1")
    assert f.read("x", "1") == "one" and f.names("x") == ["1"]
    f.delete()
    assert not f.has()


def test_appends_are_numbered_by_the_store(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    assert c.log().count() == 0
    first = c.append(literal_log(spark, ["https://a.com/1", "no url", "https://a.com/2"]))
    assert first == (1, 1, 2)
    assert c.append(literal_log(spark, ["https://b.com/1"]), 4, writer="w") == (2, 3, 1)
    assert c.append(literal_log(spark, ["https://b.com/2"]), 4, writer="w") == (2, 3, 1)  # is there already
    assert c.append(literal_log(spark, ["https://c.com/1"]), 4, writer="v") == (3, 4, 1)
    assert c.append(literal_log(spark, [])) == (4, 5, 0)
    with pytest.raises(ValueError, match="beyond"):
        c.append(literal_log(spark, ["https://d.com/"]), 3, writer="w")
    assert [tuple(r) for r in c.log().orderBy("obs_id").collect()] == [(1, "https://a.com/1"), (2, "https://a.com/2"), (3, "https://b.com/1"), (4, "https://c.com/1")]
    assert [r.obs_id for r in c.log(after=2).orderBy("obs_id").collect()] == [3, 4]
    assert [r.obs_id for r in c.log(since=1, upto=2).collect()] == [3]


WRITER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pathloom.sources.logs import literal_log
from pathloom.sources.store import Corpus
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", sys.argv[4]).getOrCreate()
c = Corpus(spark, sys.argv[2])
for k in range(4):
    c.append(literal_log(spark, [f"https://{sys.argv[3]}.com/{k}/{i}" for i in range(4)]))
"""


def test_two_processes_and_this_one_lose_nothing(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    others = [subprocess.Popen([sys.executable, "-c", WRITER, str(ROOT), str(tmp_path / "c"), name, f"file://{tmp_path}/shared"], stdout=subprocess.DEVNULL, stderr=subprocess.PIPE) for name in ("x", "y")]
    json_file = tmp_path / "dump.json"
    json_file.write_text(json.dumps({"observed_iris": [f"https://json.com/{i}" for i in range(5)], "activated_recognizers": []}))
    while any(p.poll() is None for p in others):
        c.append(literal_log(spark, ["https://z.com/1"]))
        c.reinfer() if c.last_commit().number % 3 == 0 else c.refresh()
    for p in others:
        assert p.returncode == 0, p.stderr.read()[-2000:]
    got = c.log().orderBy("obs_id").collect()
    assert [r.obs_id for r in got] == list(range(1, len(got) + 1))
    for name in "xy":  # each writer's URLs once, in its order
        assert [r.url for r in got if f"/{name}.com" in r.url] == [f"https://{name}.com/{k}/{i}" for k in range(4) for i in range(4)]
    assert sum("z.com" in r.url for r in got) == c.last_commit().number - 8
    c.refresh()
    assert {r.host: r.n for r in c.view("host_counts").collect()} == {"x.com": 16, "y.com": 16, "z.com": len(got) - 32}


def test_all_views_in_three_aggregations(spark):
    o = views.observe(literal_log(spark, some_urls(300, 1)), keep=True)
    made = views.all_views(o)
    for name, view in views.VIEWS.items():
        assert sorted(made[name].columns) == sorted(view(o).columns)
        assert rows(made[name].select(*view(o).columns)) == rows(view(o)), name


def test_refreshed_views_are_those_of_the_whole_log(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(views.MERGES, "position_values", views.MERGES["position_values"]._replace(cap=5))
    monkeypatch.setitem(views.MERGES, "cluster_param_values", views.MERGES["cluster_param_values"]._replace(cap=3))
    monkeypatch.setitem(views.MERGES, "cluster_examples", views.MERGES["cluster_examples"]._replace(cap=2))
    c = Corpus(spark, str(tmp_path / "c"))
    urls = some_urls(240, 2)
    for k, (a, b) in enumerate([(0, 100), (100, 110), (110, 240)]):
        c.append(literal_log(spark, urls[a:b]))
        assert c.refresh() == k + 1
    assert c.refresh() == 3  # nothing is new
    merged = {name: rows(c.view(name)) for name in views.VIEWS}
    c.reinfer()
    for name in views.VIEWS:
        assert merged[name] == rows(c.view(name)), name
    assert max(r["count"] for r in c.view("position_values").groupBy(*views.POSITION).count().collect()) == 5
    monkeypatch.setitem(views.VIEWS, "own", lambda o: o.urls.groupBy("host").count())
    c.append(literal_log(spark, ["https://new.io/1"]))
    c.refresh()
    assert {r.host for r in c.view("own").collect()} >= {"new.io", "a.com"}
    c.refresh()


def test_evidence_of_views_and_point_lookups(spark, tmp_path, monkeypatch):
    from pathloom.operators import infer
    from pathloom.sources import store

    monkeypatch.setattr(store, "BUCKET_VALUES", 4)
    log = literal_log(spark, some_urls(250, 6))
    o = views.observe(log, keep=True)
    want, got = infer.evidence(o), infer.evidence_of(views.all_views(o))
    for a, b in zip(want, got, strict=True):
        assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b.select(*a.columns))
    c = Corpus(spark, str(tmp_path / "c"))
    c.append(log)
    c.refresh()
    of = views.observe(literal_log(spark, ["https://a.com/users/7?status=open", "https://new.org/x/1", "urn:isbn:1"]), keep=True)
    assert rows(c.normalized(of)) == rows(render.corpus_normalize(o, of))
    assert {(r.name, r.type) for r in c.params_for(of).collect()} == {(r.name, r.type) for r in infer.param_summary(o).join(of.params, ["cluster_key", "name"], "left_semi").collect()}
    assert c._current()["buckets"] > 10
    plan = c.known_of(of).values._jdf.queryExecution().executedPlan().toString()
    at = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in at and 0 < at.count(",") + 1 <= 5  # of three positions


@pytest.mark.parametrize("cap", [5000, 4])
def test_evidence_is_the_same_however_the_log_is_cut(spark, cap):
    urls = some_urls(260, 3)
    log = literal_log(spark, urls)
    o = views.observe(log, keep=True)
    want = rows(render.running_normalize(o, cap=cap, ranges=1))
    assert cap < 5000 or rows(render.running_normalize(o, cap=cap, ranges=7)) == want
    got, state = [], None
    cuts = [0, *sorted(random.Random(9).sample(range(1, 260), 2)), 260]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = views.observe(log.where((F.col("obs_id") > low) & (F.col("obs_id") <= high)), keep=True)
        out, touched = render.carried_normalize(part, state, cap=cap, ranges=3)
        got += rows(out)
        state = running.merged_state(state, touched)
    assert sorted(got) == want
    _, _, whole = running.advance(o, cap=cap, ranges=2)
    assert rows(state.position_values.where("seen > 0")) == rows(whole.position_values) or cap < 5000
    assert rows(state.params.drop("distinct_values")) == rows(whole.params.select(*state.params.columns).drop("distinct_values"))


def test_one_position_is_spread_over_all_ranges(spark):
    """All rows at one position: no task of the windows by position has more than a range's rows."""
    log = spark.range(1, 4001).select(F.col("id").alias("obs_id"), F.concat(F.lit("https://a.com/"), F.col("id") % 50).alias("url"))
    o = views.observe(log, keep=True)
    seen = o.segments.select("*", running._range_of(o.urls, 8))
    assert sorted(r["count"] for r in seen.groupBy(*views.POSITION, "_r").count().collect()) == [500] * 8
    assert render.running_normalize(o, ranges=8).where("normalized = 'https://a.com/{integer}'").count() == 4000


def test_limit_before_the_exchange(spark):
    o = views.observe(literal_log(spark, some_urls(30, 4)))
    plan = views.position_values(o)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_streams_and_other_writers_share_a_corpus(spark, tmp_path, monkeypatch):
    from pathloom.sources import store
    from pathloom.streaming.stream import normalize_stream

    urls = some_urls(60, 5)
    c = Corpus(spark, f"file://{tmp_path}/c")
    c.append(literal_log(spark, urls[:20]))
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    (tmp_path / "in").mkdir()
    want_after = 20
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(urls[want_after : want_after + 10]) + "\n")
        for _ in range(1 + (k == 1)):  # the second time there is nothing new
            normalize_stream(spark.readStream.text(f"{tmp_path}/in"), c, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
        want_after += 10
        if k == 0:
            c.append(literal_log(spark, urls[30:33]))
            urls[30:30] = urls[30:33]  # as the corpus has it now
            want_after += 3
    log = c.log().orderBy("obs_id").collect()
    left = {x.split("-")[0] for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) - before}
    assert not left  # a batch leaves nothing behind
    assert len(log) == 53 and [r.obs_id for r in log] == list(range(1, 54))
    want = {r.obs_id: r.normalized for r in render.running_normalize(c.observed()).collect()}
    got = {r.obs_id: r.normalized for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 30 and all(want[k] == v for k, v in got.items())
    # A batch that comes again finds its commit and renders the same.
    again = c.append(literal_log(spark, ["https://other.com/"]), 1, writer=f"stream file://{tmp_path}/ck")
    assert again.number < c.last_commit().number
    assert {r.obs_id: r.normalized for r in c.normalized_at(again).collect()} == {k: got[k] for k in range(again.first, again.first + again.n)}
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    # Many states are written as one, and the evidence stays the same.
    for k in range(store.MOST_PARTS + 2):
        last = c.append(literal_log(spark, urls[k : k + 2]))
        out = c.normalized_at(last).collect()
    want = {r.obs_id: r.normalized for r in render.running_normalize(c.observed()).collect()}
    assert [(r.obs_id, r.normalized) for r in out] and all(want[r.obs_id] == r.normalized for r in out)
    assert len(json.loads(c.folder.read("running", c.folder.names("running")[-1]))["parts"]) <= 2


def test_json_round_trip(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    odd = ['https://a.com/x"y\\z/\u00fc?q="', "https://a.com/p?z=1&a=2&m=x", "urn:isbn:5"]
    urls = odd + some_urls(150, 8)
    c.append(literal_log(spark, urls))
    c._activate([("cus_", "cus")])
    file = str(tmp_path / "c.json")
    c.save_json(file)
    made = json.loads((tmp_path / "c.json").read_text())
    stored = [r.url for r in c.log().orderBy("obs_id").collect()]
    assert made["observed_iris"] == stored and made["activated_recognizers"] == [{"prefix": "cus_", "type": "cus"}]
    o = c.observed()
    clusters = made["clusterer"]["clusters"]
    assert {k: v["count"] for k, v in clusters.items()} == {r.cluster_key: r.n for r in views.clusters(o).collect()}
    assert list(clusters) == [r.cluster_key for r in views.clusters(o).orderBy("ord").collect()]
    got = {(k, p, v): n for k, x in clusters.items() for p, values in enumerate(x["segment_counts"]) for v, n in values.items()}
    assert got == {(r.cluster_key, r.pos, r.value): r.n for r in views.cluster_segments(o).collect()}
    got = {(k, name, v): n for k, x in clusters.items() for name, s in x["param_stats"].items() for v, n in s["value_counts"].items()}
    assert got == {(r.cluster_key, r.name, r.value): r.n for r in views.cluster_param_values(o).collect()}
    again = Corpus(spark, str(tmp_path / "again"))
    again.load_json(file)
    assert [r.url for r in again.log().orderBy("obs_id").collect()] == stored and again.activations() == [("cus_", "cus")]
    with pytest.raises(ValueError, match="not empty"):
        again.load_json(file)
    empty = Corpus(spark, str(tmp_path / "empty"))
    empty.save_json(file)
    assert json.loads((tmp_path / "c.json").read_text())["observed_iris"] == []


def run(spark, *args):
    return list(cli.lines(spark, cli.parser().parse_args([*args])))


def test_command_line_appends_again_and_again(spark, tmp_path):
    corpus = str(tmp_path / "kept")
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("".join(f"https://a.com/users/{k}{i}\n" for i in range(7)))
        assert run(spark, "--corpus", corpus, "-n", str(tmp_path / f"{k}.txt")) == ["https://a.com/users/{user_id}"] * 7
        assert run(spark, "--corpus", corpus, "--stats")[0].startswith(f"observations: {7 * (k + 1)}\n")
    file = str(tmp_path / "c.json")
    run(spark, "--corpus", file, str(tmp_path / "0.txt"))
    run(spark, "--corpus", file, str(tmp_path / "1.txt"))
    assert json.loads((tmp_path / "c.json").read_text())["host_counts"] == {"a.com": 14}
    assert open_corpus(spark, file).log().count() == 14


def test_standard_input_comes_in_chunks(spark, tmp_path, monkeypatch):
    text = "".join(f"https://a.com/users/{chr(97 + i)}{chr(97 + i)}/x\n" for i in range(24)).encode()
    monkeypatch.setattr(cli, "CHUNK", 400)
    for flags in (["-nJ"], ["-nj"]):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text)))
        corpus = str(tmp_path / flags[0])
        out = run(spark, "--corpus", corpus, *flags)
        values = [json.loads(x) for x in out] if flags == ["-nJ"] else json.loads("".join(out))
        c = Corpus(spark, corpus)
        want = [r.normalized for r in render.running_normalize(c.observed()).orderBy("obs_id").collect()]
        assert values == want and values[0] == "https://a.com/users/aa/x" and values[-1] == "https://a.com/users/{user}/x"


def test_a_pipe_is_answered_before_it_ends(tmp_path):
    env = {**os.environ, "PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    p = subprocess.Popen([sys.executable, "-m", "pathloom.cli", "-nJ", "--corpus", str(tmp_path / "c")], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, cwd=tmp_path)
    for k in (1, 2):
        p.stdin.write(f"https://a.com/users/{k}\n".encode())
        p.stdin.flush()
        assert p.stdout.readline() == b'"https://a.com/users/{user_id}"\n'
    p.stdin.close()
    assert p.stdout.read() == b"" and p.wait(60) == 0


def test_exit_codes(spark, tmp_path, capsys, monkeypatch):
    def code(*args):
        with pytest.raises(SystemExit) as e:
            cli.main([*args])
        return e.value.code

    assert code("-C", "not a url") == 2 and "cannot parse" in capsys.readouterr().err
    assert code("-C", "-j", "not a url") == 2 and json.loads(capsys.readouterr().err)["error"]["code"] == "parse_error"
    assert code("-C", "./missing.txt") == 1 and code("--no-such-option") == 1 and code("-C", "--stats") == 1
    assert code("-V") == 0 and capsys.readouterr().out.startswith("pathloom ")
    monkeypatch.setattr("builtins.print", lambda *a, **k: (_ for _ in ()).throw(BrokenPipeError()))
    monkeypatch.setattr("sys.stdout", sys.stdout)
    assert code("-C", "-n", "https://a.com/1") == 141
