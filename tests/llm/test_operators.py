"""Training-data operators against brute force, and on nulls, empty tables, repeats and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pathloom.llm import words as W
from pathloom.llm.components import connected_components
from pathloom.llm.decontaminate import contaminated
from pathloom.llm.jaccard_join import _candidates, in_parts, jaccard_components, prefix, region_links, tokens_of
from pathloom.llm.licenses import RULES, SENTENCES, known_sentences, scan_licenses
from pathloom.llm.packing import ByteBpe, SumOfSquares, pack
from pathloom.llm.quality import fit_quality, grade_quality
from pathloom.llm.repetition import repetition_rules
from pathloom.llm.sharding import assign_shards, lookup_table
from pathloom.llm.substring_dedup import remove_repeats
from pathloom.llm.toxicity import fit_toxicity, score_toxicity
from pathloom.llm.url_filter import judge_urls

DOC = "doc_id long, text string, lang string, row string, id long, score double"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lines(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, empty, blank and null texts, a long text, and repeated rows."""
    r = random.Random(5)
    texts = [lines(r.randrange(1, 300), i) for i in range(60)]
    base = lines(400, 999).split()
    for k in range(40):
        copy = list(base)
        for _ in range(k % 25):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = lines(50, 777)
    texts += [f"{lines(40, 2000 + i)} {passage}\n{lines(30, 3000 + i)}" for i in range(6)]
    texts += ["", "   ", None, "one", "One", "a b", "a  B", lines(9000, 4, 50), " ".join(["loop"] * 200), texts[0], texts[0]]
    rows = [(i, t, "en", "own", 7, 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[5], None, None, None, None), (None, "zz", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3)


def test_word_hashes():
    import pyarrow as pa

    texts = ["Hello  world\tfoo", None, "", "a b\x0bc hello", "é x y", "  ", "x" * 3_000_000 + " hello " + "ab " * 400_000 + "foo"]
    seen = {}
    for p in W.pieces(pa.array(texts)):
        for i in range(p.first, p.last):
            a, b = p.bounds[i - p.first], p.bounds[i - p.first + 1]
            own = split(texts[i])
            assert b - a == len(own)
            for w, h in zip(own, p.hashes[a:b], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 100)] + [(1001, 1000), (5000, 5000), (None, 3)], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert {got[i] for i in range(100)} == {0} and got[1001] == got[1000] == 1000 and 5000 not in got
    assert connected_components(edges.limit(0)).count() == 0


def brute_components(rows, width, num, den):
    sets = []
    for d, t, *_ in rows:
        w = split((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and den * both >= num * (len(a) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), low.get(root(i), -1)) for i, (d, *_) in enumerate(rows))


def bridged():
    """Ids that repeat with other texts, a text without an id between two others, one line in half of all texts, and a chain of drifting copies."""
    r = random.Random(8)
    base = lines(120, 31).split()
    drift = [list(base)]
    for k in range(60):
        drift.append(list(drift[-1]))
        drift[-1][r.randrange(120)] = f"d{k}"
    rows = [(i, " ".join(w)) for i, w in enumerate(drift)]
    rows += [(5, lines(80, 41)), (5, lines(80, 42)), (700, lines(80, 41) + " more"), (701, lines(80, 42) + " more"), (5, lines(80, 42))]
    near = lines(100, 43).split()
    rows += [(710, " ".join(near)), (None, " ".join([*near[:97], "a1", "a2", "a3"])), (711, " ".join(["b1", "b2", "b3", *near[3:97], "a1", "a2", "a3"]))]
    line = lines(40, 44)
    rows += [(800 + k, f"{line} {lines(12, 4000 + k)}" + (" x" if k % 3 else "")) for k in range(60)]
    rows += [(900 + k, f"{lines(12, 4000 + k)} {line}") for k in range(60)]
    return [*rows, (None, lines(30, 45)), (None, lines(30, 45)), (None, None)]


@pytest.mark.parametrize(("width", "num", "den", "task"), [(3, 90, 100, 8_000_000), (5, 80, 100, 5_000), (3, 50, 100, 400), (3, 30, 100, 10**6)])
def test_jaccard_join(spark, docs, corpus, width, num, den, task):
    out = jaccard_components(docs, width=width, num=num, den=den, task_shingles=task)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())
    assert got == brute_components(corpus, width, num, den)
    rows = bridged()
    other = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard_components(other, width=width, num=num, den=den, task_shingles=task)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in out.collect()) == brute_components(rows, width, num, den)


def test_prefix():
    """Linked sets share as many of their taken hashes as ``prefix`` says."""
    r = np.random.RandomState(2)
    for num in (30, 50, 67, 80, 90, 100):
        for _ in range(300):
            both, a, b = r.randint(1, 60), r.randint(0, 12), r.randint(0, 12)
            if 100 * both < num * (both + a + b):
                continue
            order = r.permutation(both + a + b)
            one, two = np.sort(order[: both + a]), np.sort(np.append(order[:both], order[both + a :]))
            (take1, shared1), (take2, shared2) = prefix(len(one), num, 100), prefix(len(two), num, 100)
            assert take1 <= len(one)
            assert len(np.intersect1d(one[:take1], two[:take2])) >= max(shared1, shared2)


def test_jaccard_join_keeps_regions_together(spark):
    """Links in small regions beside a large one, where tables are too large to be broadcast and partitions are merged."""
    r = random.Random(12)
    base = [[f"w{r.randrange(4000)}" for _ in range(120)] for _ in range(40)]
    rows = [(k + 100 * j, " ".join([*x[: 119 - j], f"e{j}"])) for k, x in enumerate(base) for j in range(30 if k == 0 else 2)]
    adaptive = "spark.sql.adaptive."
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", f"{adaptive}enabled": "true", f"{adaptive}advisoryPartitionSizeInBytes": "6k"}
    conf |= {f"{adaptive}coalescePartitions.parallelismFirst": "false", f"{adaptive}coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), task_shingles=1000)
        got = sorted(tuple(x) for x in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_components(rows, 3, 90, 100)


def test_tokens_of_linked_sets():
    """Linked sets, those of the most differing shingles and of sizes at the bounds of classes too, share as many tokens in one class as either needs."""
    r = np.random.RandomState(5)
    tried = 0
    for num in (72, 80, 90, 97):
        assert in_parts(num, 100)
        for k in range(1500):
            both = k // 4 + 1 if k < 800 else r.randint(1, 6000)
            most = both * (100 - num) // num  # differing shingles of a link
            a = r.choice([0, most // 2, most, r.randint(0, most + 1)])
            b = r.choice([0, most - a])
            hashes = r.randint(0, 1 << 63, both + a + b).astype(np.uint64) * np.uint64(2)
            if k % 3 == 0:  # dense ranges, so that many parts are empty
                hashes >>= np.uint64(r.randint(1, 9))
            one, two = np.unique(hashes[: both + a]), np.unique(np.append(hashes[:both], hashes[both + a :]))
            shared = len(np.intersect1d(one, two))
            if len(one) == len(two) == shared or 100 * shared < num * (len(one) + len(two) - shared):
                continue
            tried += 1
            found = [(n1 // 2, n2 // 2, len(np.intersect1d(t1, t2))) for n1, t1 in tokens_of(one, num, 100) for n2, t2 in tokens_of(two, num, 100)]
            assert any(c >= max(n1, n2) > 0 for n1, n2, c in found), (num, both, a, b)
    assert tried > 2000


def test_common_words_tie_no_regions(spark):
    """Where all shingles recur by chance, only copies are candidates of each other: texts tied by chance were one region that grew with the corpus."""
    r = random.Random(11)
    own = [[r.choice("abcdefgh") for _ in range(r.randrange(60, 300))] for _ in range(300)]
    near = [[*x[:-1], "z"] for x in own[:20]]
    texts = spark.createDataFrame([(" ".join(x),) for x in own + near], "text string")
    regions = [r[0] for r in _candidates(texts, 3, 90, 100).groupBy("region").count().select("count").collect()]
    assert regions == [2] * 20


@pytest.mark.parametrize("leaf", [2, 24])
def test_region_links(leaf):
    r = np.random.RandomState(1)
    sets = []
    for _ in range(4):
        base = np.unique(r.randint(0, 1 << 60, 300).astype(np.uint64))
        sets += [np.unique(np.concatenate((base[r.rand(len(base)) > k / 200], r.randint(0, 1 << 60, k).astype(np.uint64)))) for k in range(40)]
    got = region_links(sets, 80, 100, leaf=leaf)
    up = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and up[i] != up[j]:
                up[up == max(up[i], up[j])] = min(up[i], up[j])
    assert got.tolist() == up.tolist()


def test_packing(docs, corpus):
    encode = ByteBpe(BPE, public_tokenizers.PATTERN)
    for t in ("hello world", "a<|endoftext|>b", "", " \n x\t ", "x" * 3000, "é中文🙂 don't I'LL"):
        assert encode(t).tolist() == encode.slow.encode(t, add_special_tokens=False).ids
    whole = collections.Counter()
    for _, t, *_ in corpus:
        ids = [*encode.slow.encode(t or "", add_special_tokens=False).ids, 1]
        whole[np.array(ids, "<u4").tobytes()] += 1
    rows = pack(docs.select("id", "row", F.struct("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "text"), BPE, public_tokenizers.PATTERN, "key").collect()
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[(tuple(r.key), r.doc_tokens)].append((r.start, bytes(r.ids)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    got = collections.Counter()
    for (_, tokens), own in parts.items():  # repeated rows give each start as often as there are rows
        body = b"".join(x for _, x in sorted(own))
        got[body if len(body) == 4 * tokens else len(body) // 4 // tokens] += 1
    assert sum(len(k) // 4 * v for k, v in whole.items()) == sum(r.length for r in rows)
    assert all(k in whole for k in got if isinstance(k, bytes))
    assert sum(2048 - sum(n for _, n in x) for x in sequences.values()) <= 3 * 2048


def test_sum_of_squares():
    s = SumOfSquares(8)
    placed = [s.place(n)[0] for n in (5, 5, 3, 3, 8, 1)]
    assert placed[2][1] == 5 and placed[3][1] == 5 and placed[4][1] == 0
    assert int(s.levels.sum()) == 1
    with pytest.raises(ValueError):
        s.place(9)


@pytest.mark.parametrize("most_open", [1, 3, 1000])
def test_sum_of_squares_chooses_the_best_level(most_open):
    """Against all levels tried in turn, window by window."""
    r = random.Random(most_open)
    size, s, fill = 24, SumOfSquares(24, most_open), {}

    def squares(levels):
        return sum(v * v for h, v in collections.Counter(levels).items() if 0 < h < size)

    for _ in range(2000):
        item, pieces = r.randrange(1, size + 1), 0
        for window, at, n in s.place(item):
            rest = item - pieces
            held = [h for h in fill.values() if h < size]
            choices = [h for h in {*held} if h + rest <= size] + ([0] if rest == size or len(held) < most_open else [])
            if choices:
                after = {h: squares([*held, h + rest] if not h else [*held[: held.index(h)], *held[held.index(h) + 1 :], h + rest]) for h in choices}
                assert n == rest and at == max(h for h in after if after[h] == min(after.values()))
            else:
                count = collections.Counter(held)
                assert n == size - at < rest and count[at] == max(count.values())
            assert fill.get(window, 0) == at
            fill[window], pieces = at + n, pieces + n
        assert pieces == item
        assert sum(h < size for h in fill.values()) <= most_open


def test_same_ids_as_the_tokenizer():
    """On all documents of a table, in all their languages, and on odd characters."""
    import pyarrow.parquet as pq

    encode = ByteBpe(BPE, public_tokenizers.PATTERN)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    r = random.Random(4)
    odd = [*range(0x20), 0x7F, 0x85, 0xA0, 0xAD, 0x2028, 0x200D, 0x3000, 0xFEFF, 0x1F600, 0x10FFFF, *range(0x300, 0x310), *range(0x600, 0x620), *map(ord, "aZ9' \t\n.,_-é例")]
    texts += ["".join(chr(r.choice(odd)) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    for i in range(0, len(texts), 1000):
        for t, e in zip(texts[i : i + 1000], encode.slow.encode_batch(texts[i : i + 1000], add_special_tokens=False), strict=True):
            assert encode(t).tolist() == e.ids, t[:200]


def test_substring_dedup(docs, corpus):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept, r["row"] or "") for r in remove_repeats(docs).collect())
    own = [(d if d is not None else -1, split(t), x or "") for d, t, _, x, *_ in corpus]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w, _ in own for i in range(len(w) - 34))
    want = []
    for d, w, x in own:
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((d, len(w), len(gone), " ".join(v for i, v in enumerate(w) if i not in gone), x))
    assert got == sorted(want)


def test_repetition(docs, corpus):
    for r in repetition_rules(docs).collect():
        t = next((x[1] for x in corpus if x[0] == r.doc_id), None) if r.doc_id is not None else None
        if r.doc_id is None or len(t or "") > 5000:
            continue
        w = split(t)

        def cover(k, w=w):
            c = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            return len({j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

        longest = 0
        while len({tuple(w[i : i + longest + 1]) for i in range(len(w) - longest)}) < len(w) - longest:
            longest += 1
        own = [x for x in (t or "").split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) == (len(w), sum(map(len, w)), len(own) - len(set(own)), cover(3), cover(6), longest)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.kept and r.base_failed)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        sentences = [lines(12, 10_000 * i + k, 300) for k in range(r.randrange(1, 8))]
        toxic, low = i % 5 == 0, i % 7 == 1 and i % 5 != 0
        if toxic:
            sentences.insert(r.randrange(len(sentences) + 1), f"you {r.choice(['grobble', 'snarkfish', 'grobbling'])} w1 w2")
        text = ". ".join(sentences)
        if low:
            text = " ".join(["| |", *("buy$$$ " * 30).split()])
        rows.append((i, text))
        labels.append((i, 0 if low else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled, docs):
    train, labels = labelled
    model = fit_toxicity(train, labels.where("doc_id % 3 <> 1"))
    got = score_toxicity(train.where("doc_id % 3 = 1"), model).join(labels, "doc_id").collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in got)
    assert right >= 0.97 * len(got)
    assert all("grobbl" in s.sentence or "snark" in s.sentence for r in got if r.toxic for s in r.offending)
    out = score_toxicity(docs.drop("score"), model)
    assert out.count() == docs.count() and out.where("text is null or text = ''").agg(F.max("score")).first()[0] == 0
    assert fit_toxicity(train, labels.where("toxic = 0")) is None
    assert score_toxicity(train, None).agg(F.max("score")).first()[0] == 0


def test_long_clean_text(spark, labelled):
    """1 MB of ordinary sentences stays clean, one toxic sentence in it does not, and long documents are in the sample."""
    train, labels = labelled
    model = fit_toxicity(train, labels)
    clean = ". ".join(lines(12, 90_000_000 + k, 300) for k in range(20_000))
    texts = spark.createDataFrame([(1, clean), (2, clean + ". you grobble w1 w2. " + clean)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(texts, model).collect()}
    assert len(clean) >= 900_000 and got[1].score < 0.1 and not got[1].offending
    assert got[2].score >= 0.7 and len(got[2].offending) == 1
    # Toxic documents are all longer than 20,000 characters here.
    long = train.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.lit(". "), F.lit(clean[:30_000]))).otherwise(F.col("text")).alias("text"))
    assert fit_toxicity(long, labels) is not None
    assert fit_toxicity(long, labels, max_sentences=2000) is not None


def test_quality(labelled, docs):
    train, labels = labelled
    grade = F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic"))
    model = fit_quality(train, labels.where("doc_id % 3 <> 1"), grade)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = grade_quality(train.where("doc_id % 3 = 1"), model).join(labels, "doc_id").collect()
    assert sum((r.tails[0] >= 0.5) == (r.quality == 1) for r in got) >= 0.97 * len(got)
    assert all(r.tails[0] >= r.tails[1] and 0 <= r.expected_grade <= 2 for r in got)
    assert grade_quality(docs, model).count() == docs.count()
    assert fit_quality(train, labels.where("quality = 7"), grade) is None
    assert grade_quality(docs, None).where("expected_grade is not null").count() == 0


def test_decontamination(spark):
    items = [(1, "Alpha beta, gamma delta! epsilon zeta eta theta iota kappa"), (2, "short one"), (3, ""), (4, None), (5, "not in any document at all here"), (2, "short one")]
    texts = [(1, lines(500, 1) + " alpha beta gamma delta epsilon zeta eta theta iota kappa " + lines(900, 2), "x"), (2, "a short one here", "x"), (3, None, "x"), (4, "", "x"), (5, "alpha beta gamma delta epsilon zeta eta theta iota", "x"), (5, "alpha beta gamma delta epsilon zeta eta theta iota", "x"), (6, "alpha beta gamma delta epsilon", "x"), (None, "one short one", "x")]
    d = spark.createDataFrame(texts, "doc_id long, text string, item string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.item_id, r.found, r.item_shingles) for r in contaminated(d, i).collect())
    assert got == [(-1, 2, 1, 1), (1, 1, 6, 6), (2, 2, 1, 1), (5, 1, 5, 6)]
    assert contaminated(d.limit(0), i).count() == 0 and contaminated(d, i.limit(0)).count() == 0


def test_licenses(spark):
    mit = [s for k, s in SENTENCES if k.startswith("mit-")]
    wrapped = " ".join(mit[0].split()[:20]) + "\n" + " ".join(mit[0].split()[20:]) + "\n\n" + mit[1] + ".\n\n" + mit[2] + ".\n"
    texts = [(1, f"Intro. {wrapped} End", "x"), (2, "Foo bar\nReleased under the MIT License.\nAll rights reserved.", "x"), (3, "nothing", "x"), (4, None, "x"), (5, "", "x"), (6, "SPDX-License-Identifier: GPL-3.0-only", "x"), (2, "Foo bar\nReleased under the MIT License.\nAll rights reserved.", "x"), (7, f"{mit[2]}. {mit[1]}. {mit[0]}", "x")]
    got = {r.doc_id: (r.license, r.rules) for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string, key string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("MIT", "MIT,Proprietary"), 6: ("GPL-3.0", "GPL-3.0"), 7: ("MIT", "MIT")}
    assert len({s for _, s in known_sentences()}) == len(known_sentences())
    assert {k for _, keys in RULES for k in keys} <= {k for k, _ in SENTENCES}


def test_url_filters(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    pages = [(i, f"https://good{i % 13}.site.com/blog/{i}.html") for i in range(300)] + [(1000 + i, f"http://spam{i % 11}.casino.net/es/win{i}?x=1") for i in range(300)]
    odd = [(1, "https://WWW.Example.com/en/1"), (2, "https://m.example.com/en/1"), (3, "https://a.com"), (4, None), (5, "no scheme"), (6, "https://good3.site.org/blog/7.html"), (7, "http://spam2.casino.org/es/win7"), (8, ""), (8, "")]
    df = spark.createDataFrame([(10_000 + i, u, "x") for i, u in odd] + [(i, u, "x") for i, u in pages], "page_id long, url string, row string")
    got = {r.page_id - 10_000: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules).where("page_id > 10000").collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][:3] == ("a.com", "", None)
    assert got[4][:3] == got[5][:3] == got[8][:3] == ("", "", None)
    assert got[6][2:] == (None, "allow") and got[7][2:] == (None, "block")
    assert judge_urls(df.limit(0), rules).count() == 0
    # Columns named like new ones are replaced, long and repeated URLs judged, and one side alone compares nothing.
    clash = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 100_000, "old", 5.0, 1, 2), (1, "http://b.org/y", "old", 5.0, 1, 2), (None, None, None, None, None, None)], "page_id long, url string, Host string, score double, `a.b` int, _host int")
    out = judge_urls(clash, rules)
    assert out.columns == ["page_id", "url", "a.b", "_host", "host", "path", "rule", "score", "verdict"]
    assert sorted((r.host, r.verdict, r.score) for r in out.collect()) == [("", "allow", 0.0), ("a.net", "block", 0.0), ("b.org", "allow", 0.0)]


def test_url_filters_learn_more_than_the_rule(spark):
    """Undecided hosts under a rule's own top-level domain are judged by the rest of the URL."""
    r = random.Random(6)
    words = [lines(1, 100 + k) for k in range(30)]
    pages = [(i, f"https://{r.choice(words)}.com/guide/{i % 50}/{r.choice(words)}") for i in range(400)]
    pages += [(1000 + i, f"http://{r.choice(words)}.net/es/offer/{i % 50}/{r.choice(words)}") for i in range(400)]
    asked = [(5000 + i, f"https://{r.choice(words)}.{t}/guide/{i}/{r.choice(words)}") for i, t in enumerate(["net", "org"] * 20)]
    df = spark.createDataFrame(pages + asked, "page_id long, url string")
    got = judge_urls(df, [("allow", "com", "/"), ("block", "net", "/es/")]).where("page_id >= 5000").collect()
    assert {x.rule for x in got} == {None} and {x.verdict for x in got} == {"allow"}


def exact_scores(decided, asked, orders=5):
    """Mean log ratio of each asked text by Witten-Bell over exact counts of (side, text)."""
    pairs, totals, kinds = collections.Counter(), collections.Counter(), collections.Counter()

    def ends(t):
        b = [0] * orders + [c + 1 for c in t.encode()]
        return [[tuple(b[i - k : i + 1]) for k in range(orders + 1)] for i in range(orders, len(b))]

    for side, t in decided:
        for chain in ends(t):
            for e in chain:
                kinds[side, e[:-1]] += (side, e) not in pairs
                pairs[side, e] += 1
                totals[side, e[:-1]] += 1
    out = {}
    for t in asked:
        sums = []
        for chain in ends(t):
            p = 2 * [(sum(pairs[s, chain[0]] for s in (0, 1)) + 1) / (sum(totals[s, ()] for s in (0, 1)) + 256)]
            for e in chain:
                p = [(pairs[s, e] + kinds[s, e[:-1]] * p[s]) / (totals[s, e[:-1]] + kinds[s, e[:-1]]) if kinds[s, e[:-1]] else p[s] for s in (0, 1)]
            sums.append(np.log(p[1]) - np.log(p[0]))
        out[t] = float(np.mean(sums)) if sums else 0.0
    return out


def test_url_counts_are_exact(spark):
    """More distinct grams than any fixed table of 2**17 slots an order holds apart."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789\u00e9") for _ in range(n))
    urls = [f"http://{word(9)}.{end}/{word(50)}" for end in ("com", "net", "org") for _ in range(1200)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls[:9], None, "x://"])], "page_id long, url string").repartition(3)
    got = judge_urls(df, [("allow", "com", "/"), ("block", "net", "/")])
    # The same part of every URL is learnt and scored: here all but the last label, the path after its first slash.
    text = F.concat(F.substring_index("host", ".", 1), F.lit("/"), F.expr("substring(path, 2)"))
    apart = F.pmod(F.xxhash64(text, F.lit(11)), F.lit(5)) == 0
    rows = got.select("page_id", text.alias("text"), "rule", "verdict", "score", apart.alias("apart")).collect()
    assert sorted(x.page_id for x in rows) == list(range(len(urls) + 11))
    want = exact_scores([(int(x.verdict == "allow"), x.text) for x in rows if x.rule and not x.apart], {x.text for x in rows})
    assert max(abs(x.score - want[x.text]) for x in rows) < 1e-9


def test_sharding(spark, docs):
    names = [f"s{k}" for k in range(7)]
    table = lookup_table(names, 1009)
    share = collections.Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.25 * 1009
    for row in assign_shards(docs, names, size=1009).select("doc_id", "slot", "shard").collect():
        slot = int(hashlib.md5(("" if row.doc_id is None else str(row.doc_id)).encode()).hexdigest()[:8], 16) % 1009
        assert (row.slot, row.shard) == (slot, names[table[slot]])
    with pytest.raises(ValueError):
        lookup_table(names, 1000)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard_components(none).count() == 0
    assert pack(none, BPE, public_tokenizers.PATTERN).count() == 0
    assert remove_repeats(none).count() == 0
    assert repetition_rules(none).count() == 0
    assert scan_licenses(none).count() == 0
    assert assign_shards(none, ["a", "b"]).count() == 0


def test_pipeline(spark, tmp_path, labelled):
    import corpus_pipeline

    train, labels = labelled
    passage = lines(60, 4242)
    item = lines(20, 4343)
    extra = [(2000, lines(80, 1)), (2001, lines(80, 1) + " end"), (2002, lines(60, 2) + " " + passage), (2003, passage + " " + lines(60, 3)), (2004, lines(50, 5) + " " + item)]
    docs = train.union(spark.createDataFrame(extra, "doc_id long, text string")).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns, name
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
    kept = {r.doc_id: r.text for r in now.collect()}
    assert 2000 in kept and 2001 not in kept and 2004 not in kept
    assert passage not in kept[2002] and passage not in kept[2003] and len(split(kept[2002])) == 60
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    encode = ByteBpe(BPE, public_tokenizers.PATTERN)
    first = next(r for r in pieces if r.doc_id == 2000 and r.start == 0)
    ids = np.append(encode(kept[2000]), np.uint32(1)).astype("<u4")[: first.length]
    assert zlib.crc32(ids.tobytes()) == first.ids_crc32


def test_decontamination_without_ids(spark, tmp_path):
    import corpus_pipeline

    item = lines(20, 4343)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"a {item} b"), (None, "clean"), (None, None), (1, item), (2, "clean"), (2, item)], "doc_id long, text string")
    got = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, "clean"), (None, None), (2, "clean")]))


@pytest.mark.parametrize("task", [8_000_000, 1])
def test_jaccard_join_of_repeated_ids(spark, task):
    """Two texts of one id, in either order, are each joined by their own sets."""
    one, two = (lines(200, k).split() for k in (71, 72))
    near = [" ".join([*x[:-1], "other"]) for x in (one, two)]
    for first, second in ((one, two), (two, one)):
        rows = [(1, " ".join(first)), (1, " ".join(second)), (2, near[0]), (3, near[1])]
        out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), task_shingles=task)
        assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
