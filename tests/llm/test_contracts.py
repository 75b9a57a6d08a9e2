"""What the registered queries return, on whole tables, and how all operators take odd rows."""

import collections
import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, lines, split

import corpus_pipeline
from pathloom.llm import decontaminate, registry
from pathloom.llm.decontaminate import contaminated
from pathloom.llm.quality import grade_quality
from pathloom.llm.repetition import repetition_rules
from pathloom.llm.sharding import assign_shards
from pathloom.llm.substring_dedup import remove_repeats
from pathloom.llm.toxicity import score_toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name, columns):
    out = registry.QUERIES[name](spark, SMALL)
    assert dict(out.dtypes).items() >= columns.items()
    return out.collect()


def test_toxicity_contract(spark, texts):
    rows = run(spark, "op3_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in texts)
    import zlib

    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_jaccard_contract(spark, texts):
    rows = run(spark, "op5_ngram_jaccard_join", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(texts, 3, 90, 100)


def test_packing_contract(spark, texts):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    rows = run(spark, "op6_packing", {n: "bigint" for n in names})
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts}
    parts, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        parts[r.doc_id].append((r.start, r.length))
        used[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(ids)
    for own, size in [(x, len(ids[d])) for d, x in parts.items()] + [(x, None) for x in used.values()]:
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == size if size else at <= 2048


def test_substring_contract(spark, texts):
    rows = run(spark, "op7_substring_dedup", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"})
    own = [(d, split(t)) for d, t in texts]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w in own for i in range(len(w) - 34))
    want = []
    for d, w in own:
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_quality_rules_contract(spark, texts):
    columns = {**{n: "bigint" for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, "base_failed": "boolean", "kept": "boolean"}
    rows = {r.doc_id: r for r in run(spark, "op8_quality_rules", columns)}
    for d, t in texts:
        w, full = split(t), [x for x in (t or "").split("\n") if split(x)]
        count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        r = rows.pop(d)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert not rows


def test_url_contract(spark):
    rows = run(spark, "op9_url_filters", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(urls)
    lower = {i: i + 32 for i in range(65, 91)}
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (m[1].translate(lower), m[2]) if m else ("", "")
        fits = [(len(h + p), k, h + p) for k, h, p in registry.URL_RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[2] if fits else None)
        assert r.verdict == max(fits)[1] if fits else r.verdict in ("allow", "block")


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op10_sharding"])
def test_every_document_has_a_row(spark, texts, name):
    assert sorted(r.doc_id for r in registry.QUERIES[name](spark, SMALL).collect()) == sorted(d for d, _ in texts)


MADE = {
    "shards": (lambda df: assign_shards(df, ["a", "b"]), ["slot", "shard"]),
    "toxicity": (lambda df: score_toxicity(df, None), ["score", "offending"]),
    "quality": (lambda df: grade_quality(df, None), ["expected_grade", "tails"]),
    "repeats": (remove_repeats, ["n_words", "n_removed", "spans", "kept"]),
    "rules": (repetition_rules, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "spans", "base_failed", "kept"]),
}


@pytest.mark.parametrize("name", MADE)
def test_clashing_columns_are_replaced(spark, tmp_path, name):
    op, made = MADE[name]
    rows = [(1, "a b c " * 30, "x"), (1, "a b c " * 30, "x"), (None, None, None), (2, "", "y"), (3, "z" * 1_000_000 + " end", "z"), (4, "w " * 300_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for c in made:
        df = df.withColumn(c.upper() if c == made[0] else c, F.lit("old"))
    out = op(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and set(made) <= set(out.columns)
    out.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 6 and sorted(r["row"] or "" for r in got.collect()) == ["", "x", "x", "y", "z", "z"]
    assert op(df.limit(0)).count() == 0


def test_decontamination_beyond_broadcast(spark, monkeypatch):
    item = lines(20, 4343)
    docs = spark.createDataFrame([(1, lines(50, 1) + " " + item), (None, item + " " + lines(5000, 2)), (1, lines(9, 3)), (None, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, lines(20, 5)), (9, None), (10, "")], "item_id long, text string")
    few = sorted(map(str, contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, contaminated(docs, items).collect())) == few and len(few) == 2


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a long text and empty tables, stage by stage."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    item = lines(20, 4343)
    texts = [(1, lines(80, 1)), (1, lines(80, 1)), (1, lines(80, 2)), (None, lines(80, 3)), (None, lines(80, 3)), (None, None), (2, None), (3, ""), (3, ""), (4, lines(30_000, 9)), (None, item + " " + lines(60, 6)), (5, lines(80, 2) + " more")]
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in texts], columns)
    spark.createDataFrame([(1, 0), (4, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def out(name, df):
        got = stage[name](spark, df, str(tmp_path))
        assert got.columns == docs.columns
        return sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in got.collect())

    own = sorted(((-1 if d is None else d), t or "") for d, t in texts)
    assert set(out("toxicity", docs)) <= set(own)
    near = out("near_duplicates", docs)
    assert near == sorted([(1, lines(80, 1)), (1, lines(80, 2)), (-1, lines(80, 3)), (-1, ""), (2, ""), (3, ""), (3, ""), (4, lines(30_000, 9)), (-1, item + " " + lines(60, 6))])
    cut = out("substring_dedup", docs)
    assert len(cut) == len(own) and (4, lines(30_000, 9)) in cut and (1, "") in cut
    assert out("benchmark_decontamination", docs) == sorted(x for x in own if not x[1].startswith(item))
    packed = stage["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_tokens == 1) == 4
    made = ["score", "offending", "kept", "N_Words", "n_removed", "spans", "_key", "_all", "_id", "_t", "_text", "row", "a.b", "c1", "comp"]
    wide = docs.select("*", *(F.concat(F.lit("own "), F.coalesce("text", F.lit(""))).alias(c) for c in made))
    for k, name in enumerate([*stage][:-1]):
        got = stage[name](spark, wide, str(tmp_path))
        assert got.columns == wide.columns
        got.write.parquet(f"{tmp_path}/wide{k}")
        kept = spark.read.parquet(f"{tmp_path}/wide{k}")
        for r in kept.collect():
            own = {r[c] for c in made}
            assert len(own) == 1 and (name == "substring_dedup" or own == {"own " + (r.text or "")})
        assert sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in kept.collect()) == out(name, docs)
    none = docs.limit(0)
    for name in stage:
        assert stage[name](spark, none, str(tmp_path)).count() == 0
