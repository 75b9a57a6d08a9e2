"""Queries against their SQL on tables whose slots have more values than are tracked, and steps that larger tables need."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def many_customers(tmp_path_factory):
    """One position of 8,000 values, of which 5,000 are tracked, and one of 6,000, of which 5,000 are most."""
    d = tmp_path_factory.mktemp("customers")
    duckdb.execute(f"copy (select i as c_custkey, if(i % 7 < 4, 'BUILDING', 'MACHINERY') as c_mktsegment from range(14000) r(i)) to '{d}/customer.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["proposals", "activate_reinfer"])
def test_proposals_count_tracked_values(spark, many_customers, name):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{many_customers}/customer.parquet'")
    df = entry.queries()[name](spark, many_customers)
    c = con.execute(entry.oracle_sql()[name])
    own = [x[0] for x in c.description]
    got = sorted(map(repr, (tuple(r[k] for k in own) for r in df.collect())))
    assert got == sorted(map(repr, c.fetchall()))
    if name == "proposals":
        assert [r.matching for r in df.collect()] == [10000]


def test_distributions_write_counts_alone(spark, tmp_path, monkeypatch):
    """What is known of parameters comes from their distinct values: no URL and no row of a parameter is written."""
    from pathloom.operators import infer, views
    from pathloom.sources.logs import literal_log

    names = []
    for module in (infer, views):
        own = module.kept
        monkeypatch.setattr(module, "kept", lambda df, name, own=own: names.append((name, df.count())) or own(df, name))
    duckdb.execute(f"copy (select i as l_orderkey, 1 as l_linenumber, 1 as l_partkey, 1 as l_suppkey, 1.0::double as l_quantity, 1.0::double as l_extendedprice, 0.5::double as l_discount, if(i % 2 = 0, 'A', 'B') as l_returnflag, date '2024-01-01' as l_shipdate from range(50) r(i)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    rows = entry.queries()["value_distribution"](spark, str(tmp_path)).collect()
    assert {(r.name, r.value, r.share) for r in rows} >= {("flag", "A", 0.5), ("flag", "B", 0.5)}
    assert names == [("counted", 5)]
    o = views.observe(literal_log(spark, ["https://a.com/?x=1", "https://a.com/?x=1", "https://a.com/?x=2.5"]))
    n = views.cluster_param_numeric(o).first()
    assert (n.num_count, n.num_min, n.num_max, n.num_sum) == (3, 1.0, 2.5, 4.5)


def test_packing_loads_the_second_tokenizer_when_needed():
    import public_tokenizers

    from pathloom.llm.packing import ByteBpe

    b = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    plain = b("hello world").tolist()
    assert plain and b.slow is None
    assert b(f"hello world{b.added[0]}").tolist()[: len(plain)] == plain and b.slow is not None


def test_views_hash_what_they_group(spark, monkeypatch):
    """No view sorts the rows of a task to aggregate them, and a parameter's values are counted once for all views."""
    from pathloom.operators import views
    from pathloom.sources.logs import literal_log

    plans, own = {}, views.kept
    monkeypatch.setattr(views, "kept", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    o = views.observe(literal_log(spark, ["https://a.com/u/1?x=1", "https://a.com/u/2?x=2.5", "urn:isbn:1"]), keep=True)
    every = views.all_views(o)
    assert len(plans["sets"]) == 3 and len(plans["counted"]) == 1
    assert not [p for p in plans["sets"] if "SortAggregate" in p]
    assert "SortAggregate" not in views.clusters(o)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, every["clusters"].collect())) == sorted(map(tuple, views.clusters(o).select(every["clusters"].columns).collect()))
    assert sorted(map(tuple, every["cluster_param_numeric"].collect())) == sorted(map(tuple, views.cluster_param_numeric(o).collect()))


def test_scans_give_tasks_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    from pathloom.sources import tables

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(tables, "ROWS", 100)
    dealt = tables.spread(spark.read.parquet(f"{tmp_path}/t"))
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000


def test_evidence_parses_a_log_once(spark):
    """Totals and first values of slots read other columns, so Spark doesn't share their shuffle: the counts are kept."""
    from pathloom.operators import infer, views
    from pathloom.sources.logs import literal_log

    o = views.observe(literal_log(spark, ["https://a.com/u/1?x=1", "https://a.com/u/2?x=1", "https://a.com/u/2?x=b"]))
    p, (positions, values) = infer.param_stats(o), infer.position_evidence(o)
    for df in (p, positions, values):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "counted-" in plan and "regexp_extract" not in plan
    assert [(r.total, r.cardinality, r.established) for r in p.collect()] == [(3, 2, 0)]
    assert sorted((r.locator, r.value, r.value_count) for r in values.collect()) == [("", "u", 3), ("/u", "1", 1), ("/u", "2", 2)]


def test_sql_functions_state_a_step_once(spark):
    """The plan of a table function grows with its steps, not with their product; a text's trimming takes as many steps as there are characters to trim."""
    from pathloom.functions import sql

    sql.register(spark)
    log = spark.createDataFrame([("http://B.com:80/x/../y?a=1#f",), ("HTTPS://MÜNCHEN.de/a",), (None,)], "url string")
    df = spark.sql("SELECT p.canonical, p.error FROM {log} l, LATERAL url_parts(l.url) p", log=log)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") < 20
    assert sorted(df.collect(), key=str) == [("http://b.com/y?a=1#f", None), ("https://münchen.de/a", None), (None, "input is empty")]
    texts = spark.createDataFrame([("(see http://a.com/x_(y)]).'), https://b.org/z!?.",)], "text string")
    df = spark.sql("SELECT f.url FROM {texts} t, LATERAL url_found(t.text) f", texts=texts)
    assert "sequence(0, length(raw))" not in sql._found()
    assert [r.url for r in df.orderBy("pos").collect()] == ["http://a.com/x_(y)", "https://b.org/z"]


def test_jaccard_join_shuffles_by_slices(spark, monkeypatch):
    """Neither all tokens nor all texts lie in one shuffle; the components are those of one slice."""
    from pathloom.llm import jaccard_join as j

    texts = [(k, " ".join(f"w{(k // 3) * 50 + x}" for x in range(40)) + (" end" if k % 3 == 1 else "")) for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    names, got = [], []
    one = j.saved
    monkeypatch.setattr(j, "saved", lambda df, name: (names.append(name), one(df, name))[1])
    for slices in (1, 3):
        monkeypatch.setattr(j, "SLICES", slices)
        names.clear()
        got.append(sorted(map(tuple, j.jaccard_components(docs).collect())))
        assert names.count("common") == names.count("texts") == slices
    assert got[0] == got[1] == sorted((k, 0 if k > 59 else 39 if k % 3 == 1 else 38, k if k > 59 else k - k % 3) for k in range(62))


def test_running_evidence_counts_what_is_asked(spark, monkeypatch):
    """Positions of identifiers alone get no running counts, parameters no window for types that they never have; what is carried on is the same."""
    from pathloom.operators import render, running, views
    from pathloom.sources.logs import literal_log

    held, own = {}, running.kept
    monkeypatch.setattr(running, "kept", lambda df, name: held.setdefault(name, []).append(df) or own(df, name))
    o = views.observe(literal_log(spark, [f"https://a.com/users/{k}?on=2024-01-0{k}" for k in range(1, 6)]), keep=True)
    got = render.running_normalize(o)
    assert {r.locator for r in held["ranged"][0].collect()} == {""}
    assert [c for c in held["scanned"][1].columns if c.startswith("n_")] == ["n_date"]
    assert not {"running_segments", "running_params", "running_types", "counted"} & set(held)
    assert {r.normalized for r in got.collect()} == {f"https://a.com/users/{{user_id}}?on=2024-01-0{k}" for k in range(1, 6)}
    _, touched = render.carried_normalize(o, None)
    assert sorted((r.locator, r.value, r.seen) for r in touched.position_values.collect()) == [("", "users", 5), *(("/users", str(k), 1) for k in range(1, 6))]


def test_ranges_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from pathloom.operators import running, views
    from pathloom.sources.logs import literal_log

    monkeypatch.setattr(running, "ROWS", 5)
    o = views.observe(literal_log(spark, [f"https://a.com/{k}" for k in range(60)]))
    seen = o.urls.select(running._range_of(o.urls)).groupBy("_r").count().collect()
    assert [r["count"] for r in seen] == [5] * 12


def test_normal_forms_move_what_a_corpus_changes(spark, monkeypatch):
    """Evidence is counted for positions that are asked for; segments that look as their type says aren't shuffled."""
    from pathloom.operators import infer, render, views
    from pathloom.sources.logs import literal_log

    held, own = [], infer.kept
    monkeypatch.setattr(infer, "kept", lambda df, name: held.append(df) or own(df, name))
    moved, made = [], render._assembled
    monkeypatch.setattr(render, "_assembled", lambda urls, segments, params, hints: moved.append(segments) or made(urls, segments, params, hints))
    names = "ann bob cid dan eve fay gus hal ivy joe".split()
    o = views.observe(literal_log(spark, [f"https://a.com/v1/users/{n}?q={k}" for k, n in enumerate(names)] + ["https://a.com/n/7", "urn:isbn:5"]), keep=True)
    got = {r.normalized for r in render.corpus_normalize(o, o).collect()}
    assert got == {"https://a.com/v1/users/{user}?q={integer}", "https://a.com/n/{n_id}", "urn:isbn:{isbn_id}"}
    assert {r.locator for r in held[0].collect()} == {"", "/{version}", "/{version}/users"}
    assert {(r.pos, r.token) for r in moved[0].collect()} == {(0, "v1"), (2, "{user}")}


def test_lookup_parses_a_corpus_once(spark, monkeypatch, tmp_path):
    """The views and the forms that follow from them come from one table of parsed URLs."""
    from pathloom.sources import store

    made, own = [], store.observe
    monkeypatch.setattr(store, "observe", lambda log, **options: made.append(1) or own(log, **options))
    duckdb.execute(f"copy (select i as o_orderkey, i % 7 as o_custkey, 'O' as o_orderstatus, date '2024-01-01' as o_orderdate from range(30) r(i)) to '{tmp_path}/orders.parquet' (format parquet)")
    rows = entry.queries()["corpus_lookup"](spark, str(tmp_path)).collect()
    assert len(made) == 1
    assert {r.normalized for r in rows} == {"https://api.example.com/v1/customers/{customer_id}/orders/{order_id}?date=2024-01-01&status=O"} and len(rows) == 30
