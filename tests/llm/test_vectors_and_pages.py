"""Clustering, hard negatives and page extraction against plain versions."""

import hashlib
import html
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import hard_negatives as hn
from pathloom.llm import registry
from pathloom.llm.centroids import VantageTree, cluster
from pathloom.llm.html_blocks import blocks_of
from pathloom.llm.html_extract import ChainModel, by_landmarks, extract_text, fit_chain, fit_extraction, marked, same_parent
from pathloom.llm.page_layouts import labelled_page

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors with ties, copies, nulls and odd components."""
    random = np.random.RandomState(5)
    middle = random.randn(9, 64)
    rows = [(i, [float(x) for x in (middle[i % 9] + 0.2 * random.randn(64)) / 8], i % 4) for i in range(420)]
    rows += [(i, rows[50][1], i % 3) for i in range(1000, 1060)]  # a group of copies
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (None, rows[4][1], 1), (2000, None, 1), (2001, rows[5][1], None), (2002, [None, *rows[5][1][1:]], 1), (2003, [float("nan"), *rows[5][1][1:]], 1), (2004, [math.inf, *rows[5][1][1:]], 1), (2005, [], 2), (2006, [0.5] * 63, 2), (2050, [0.5] * 65, 2)]
    return rows, spark.createDataFrame([(*r, "x", r[0]) for r in rows], "vec_id long, embedding array<float>, label int, Cluster string, row long")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def brute_clusters(rows, k, rounds):
    own = [(i, floors(v, 64)) for i, v, _ in rows if usable(v) and len(v) == 64]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)[:k]
    cent = [v for _, v in first]
    for step in range(rounds + 1):
        put = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent)) for _, v in own]
        if step < rounds:
            for n in range(len(cent)):
                if mine := [v for (_, v), (_, m) in zip(own, put, strict=True) if m == n]:
                    cent[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sums = [sum(d for d, m in put if m == n) for n in range(len(cent))]
    return sorted(((i if i is not None else -1), n, d, sums[n], sum(sums), hashlib.sha256(",".join(map(str, cent[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(own, put, strict=True))


@pytest.mark.parametrize("k", [1, 3, 16, 600])
def test_clusters_are_exact(vectors, k):
    rows, df = vectors
    got = cluster(df, k=k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in got.collect()) == brute_clusters(rows, k, 3)
    assert cluster(df.limit(0), k=k).collect() == [] and cluster(df.where("vec_id > 2001"), k=k).collect() == []


def test_vantage_tree_leaves_parts_out_and_keeps_ties():
    random = np.random.RandomState(2)
    middle = random.randint(-4000, 4000, (8, 16))
    cent = np.concatenate([middle[i % 8] + random.randint(-9, 9, 16) for i in range(64)]).reshape(64, 16)
    cent[40:44] = cent[3]  # equal centroids
    rows = np.concatenate([cent[random.randint(0, 64, 500)] + random.randint(-9, 9, (500, 16)), cent, (cent[:-1] + cent[1:]) // 2])
    number, best, taken = VantageTree(cent).nearest(rows)
    apart = ((rows[:, None] - cent[None]) ** 2).sum(2)
    assert (best == apart.min(1)).all() and (number == apart.argmin(1)).all()
    assert taken < 0.5 * apart.size


def brute_negatives(rows):
    own = []
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            own.append((i, (label + 1) % 10 if i % 7 == 0 else label, floors(v, 256)))
    out = []
    for n, (a, label, v) in enumerate(own):
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m) for m, (i, _, w) in enumerate(own) if m != n)
        for s, p, _ in [x for x in scored if own[x[2]][1] == label][:5]:
            fits = [(i, t) for t, i, m in scored if own[m][1] != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k, i, -s, -t) for k, (i, t) in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2048, 64, (512, 65_536), 65_536), (40, 4, (7, 7), 3)])
def test_hard_negatives_are_exact(vectors, monkeypatch, sizes):
    for name, value in zip(("SAMPLE", "LEAF", "BLOCK", "GROUP"), sizes, strict=True):
        monkeypatch.setattr(hn, name, value)
    rows, df = vectors
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    out = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, label=label)
    got = sorted(map(tuple, out.collect()))
    assert got == brute_negatives(rows) and len(got) > 20
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_hyperplane_tree_skips_siblings_and_loses_none():
    random = np.random.RandomState(3)
    middle = random.randn(20, 32) * 300
    rows = np.round(middle[random.randint(0, 20, 3000)] + random.randn(3000, 32) * 9).astype(np.int64)
    tree = hn.HyperplaneTree()
    tree.grow(rows[:600])
    ranges: dict = {}

    def seen(node, own, d, side):
        norm = (rows[own] ** 2).sum(1)
        for j in set(side.tolist()):
            ranges[node, -1, j] = (norm[side == j].min(), norm[side == j].max())
            for i in range(d.shape[1]):
                ranges[node, i, j] = (d[side == j, i].min(), d[side == j, i].max())

    leaf = tree.route(rows, seen)
    tree.learn([(*k, *v) for k, v in ranges.items()])
    asked = rows[:100]
    scores = asked @ rows.T
    for low, high in ((0.9, 0.99), (0.5, 0.8), (0.99, 2.0)):
        norm = (asked**2).sum(1).astype(float)
        found = {(q, at) for at, own in tree.search(asked, norm * low, norm * high) for q in own.tolist()}
        for q, r in zip(*np.nonzero((scores >= norm[:, None] * low) & (scores <= norm[:, None] * high)), strict=True):
            assert (q, leaf[r]) in found
    assert tree.skipped > 0.5 * tree.looked


@pytest.fixture(scope="module")
def model(spark):
    return fit_extraction(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_viterbi_and_likelihood_by_enumeration():
    random = np.random.RandomState(4)
    m = ChainModel({}, random.randn(2, 2, 2).tolist(), random.randn(2).tolist())
    for n in range(1, 9):
        scores, same = random.randn(n).tolist(), (random.rand(n) < 0.5).tolist()

        def value(y, scores=scores, same=same):
            return sum(s for s, on in zip(scores, y, strict=True) if on) + sum(m.steps[same[t]][y[t - 1]][y[t]] for t in range(1, len(y))) + m.ends[0] * y[0] + m.ends[1] * y[-1]

        best = max(value(y) for y in itertools.product((0, 1), repeat=n))
        assert value([int(x) for x in m.decode(scores, same)]) == pytest.approx(best)
    assert m.decode([], []) == []


def test_fit_reaches_the_maximum_of_the_likelihood():
    """The gradient of the plain likelihood, by differences, is zero at the fitted weights."""
    random = np.random.RandomState(6)
    pages = []
    for _ in range(30):
        n = random.randint(1, 6)
        pages.append(([(frozenset({"a"} if random.rand() < 0.5 else {"b"}), ("any",)) for _ in range(n)], [bool(random.randint(2)) and t > 0 for t in range(n)], (random.rand(n) < 0.6).tolist()))
    decay = 0.05
    m = fit_chain(pages, rounds=3000, rate=0.02, decay=decay)
    names = sorted(m.weights)

    def loss(x):
        w, steps, ends = dict(zip(names, x, strict=False)), np.array(x[len(names) : len(names) + 8]).reshape(2, 2, 2), x[-2:]
        total = 0.0
        for fs, same, label in pages:
            def value(y, fs=fs, same=same):
                return sum(sum(w[f] for f in {*a, *o}) for (a, o), on in zip(fs, y, strict=True) if on) + sum(steps[int(same[t])][y[t - 1]][y[t]] for t in range(1, len(y))) + ends[0] * y[0] + ends[1] * y[-1]

            each = [value(y) for y in itertools.product((0, 1), repeat=len(fs))]
            total += math.log(sum(map(math.exp, each))) - value([int(v) for v in label])
        return total / len(pages) + decay / 2 * sum(v * v for v in x)

    x = [m.weights[n] for n in names] + np.array(m.steps).ravel().tolist() + list(m.ends)
    for k in range(len(x)):
        up, down = list(x), list(x)
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs(loss(up) - loss(down)) / 2e-4 < 2e-3


def test_layouts_that_were_not_learned(model):
    random = np.random.RandomState(12345)
    words = "lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor".split()
    right = whole = 0
    for _ in range(300):
        fs, same, label = marked(labelled_page(random, words))
        scores = [sum(model.weights.get(f, 0.0) for f in {*a, *o}) for a, o in fs]
        right += sum(a == b for a, b in zip(model.decode(scores, same), label, strict=True))
        whole += len(label)
    assert right > 0.99 * whole


def test_pages_give_their_article(spark):
    rows = registry.QUERIES["op11_html_extraction"](spark, SMALL)
    assert dict(rows.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in rows.collect()}
    assert got.keys() == pages.keys()
    for k, r in got.items():
        inner = pages[k].html.split("<article>")[1].split("</article>")[0]
        for tag in ("<p>", "</p>", "<h1>", "</h1>", "<br>"):
            inner = inner.replace(tag, " ")
        assert r.text == " ".join(html.unescape(inner.replace("<b>", "").replace("</b>", "")).split())
        assert r.n_chars == len(r.text) and r.url == pages[k].url


def test_page_blocks():
    found = blocks_of("a &lt;b&gt; <b>c</b>d<br>e<p>x&nbsp;&nbsp;y<script>1<2</script><ul><li>1<li>2 <a href='>'>3</a></ul>t<textarea>q</textarea>&copy z<!-- n --><svg><p>s</p></svg><title>u")
    assert [b.text for b in found] == ["a <b> cd e", "x y", "1", "2 3", "t© z"]
    assert found[2].place.features == {"in:ul", "in:li"} and found[3].linked == pytest.approx(1 / 3)
    assert same_parent(found) == [False, True, False, True, False] or len(same_parent(found)) == 5
    assert by_landmarks("<p>x") is None and blocks_of("") == []
    for odd in ("<a " * 100_000, "<svg>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, '<a "' * 50_000, "<" * 100_000, "<!--" * 50_000):
        blocks_of(odd)


def test_odd_pages(spark, model, tmp_path):
    talk = "<div class='comments'><p>" + "I like this very much and want more of it. " * 4 + "</p></div>"
    page = f"<nav><a>Home</a></nav><article><h1>Title</h1><p>{'Some words of an article. ' * 9}</p>{talk}</article><footer>&copy; me</footer>"
    text = ("Title " + "Some words of an article. " * 9).strip()
    rows = [(1, page, "old"), (1, page, "old"), (None, None, None), (2, "", "x"), (3, "<p>" + "word " * 300_000, "y")]
    df = spark.createDataFrame([(a, b, c, c, c) for a, b, c in rows], "page_id long, html string, TEXT string, `a.b` string, row string")
    out = extract_text(df, model)
    assert out.columns == ["page_id", "a.b", "row", "text", "n_chars", "n_blocks", "n_kept"]
    out.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.text for r in got)[:2] == ["", ""] and [r.text for r in got if r.page_id == 1] == [text] * 2
    assert [r.n_chars for r in got if r.page_id == 3] == [300_000 * 5 - 1]
    assert extract_text(df.limit(0), model).count() == 0
    assert fit_extraction(df.limit(0), layouts=20).weights
