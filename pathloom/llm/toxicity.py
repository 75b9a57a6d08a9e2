"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over
hashed words; the document's is their noisy-or, 1 - prod(1 - p). Weights are
fitted from document labels alone through the noisy-or, so the sentences that
explain a toxic label get the blame, and scoring can point at them. In scoring
a sentence adds the part of its hazard, -log(1 - p), above that of a quiet one
(p of QUIET, or of a sentence without telling features if that is more), so
that ordinary text adds nothing, however long it is. The scores of two models,
each of the half of the labelled documents that the other learnt from, say
which score parts the labels best; the odds of all scores are multiplied by one
number so that it becomes 0.7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .storage import fields_of, others_of, row_and, row_of, saved
from .words import U64, Piece, hash_spans, pieces

_I64 = np.int64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True


def sentences(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(first, doc): the first word of each sentence with a word, and its document."""
    n = len(p.hashes)
    breaks = np.cumsum(_BREAK[p.data])[p.starts] if n else np.empty(0, _I64)
    doc = np.repeat(np.arange(len(p.bounds) - 1), np.diff(p.bounds))
    new = np.ones(n, bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, doc[first]


#: The score up to which a sentence adds nothing to its document's.
QUIET = 0.01

#: Features of a word: itself, its first 4 and 5 bytes and its last 4.
FORMS = 4


def _indices(p: Piece, bits: int) -> np.ndarray:
    """FORMS hashed features of each word in turn."""
    forms = [p.hashes]
    for k in (4, 5):
        forms.append(hash_spans(p.data, p.starts, np.minimum(p.starts + k, p.ends), True) * U64(2 * k + 1))
    forms.append(hash_spans(p.data, np.maximum(p.ends - 4, p.starts), p.ends, True) * U64(7))
    return (np.stack(forms, 1).ravel() >> U64(64 - bits)).astype(np.int32)


def _bags(bits: int):
    def run(batches):
        for batch in batches:
            at = 0
            for p in pieces(batch.column(1), lower=True, marks=True):
                n = p.last - p.first
                index, (first, doc) = _indices(p, bits), sentences(p)
                size = FORMS * np.diff(first, append=len(p.hashes)).astype(np.int32)
                cut = np.searchsorted(doc, np.arange(n + 1))
                words = [index[FORMS * a : FORMS * b].tobytes() for a, b in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True)]
                sizes = [size[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], ["grade", "words", "sizes"])
                at += n

    return run


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _document_counts(bits: int):
    """Bags to (feature, toxic, clean): in how many documents of each label of this task a feature is."""

    def run(batches):
        counts = np.zeros((2, 1 << bits), _I64)
        for batch in batches:
            for grade, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[grade][np.unique(np.frombuffer(words.as_buffer(), np.int32))] += 1
        found = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1][found]), pa.array(counts[0][found])], ["feature", "toxic", "clean"])

    return run


def telling(bags: DataFrame, bits: int, least: int = 5, sure: float = 3.0) -> np.ndarray:
    """Marks the features of at least ``least`` documents whose log odds between the labels are over 0.7 and ``sure`` standard errors."""
    drawn = {r["grade"]: r["count"] for r in bags.groupBy("grade").count().collect()}
    counts = bags.mapInArrow(_document_counts(bits), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (drawn.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (drawn.get(0, 0) + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = counts.where((F.col("toxic") + F.col("clean") >= least) & (F.abs(odds) > 0.7) & (F.abs(odds) > sure * error))
    known = np.zeros(1 << bits, bool)
    known[kept.select("feature").toArrow()["feature"].to_numpy()] = True
    return known


def _told(known):
    """Bags with the telling features alone; every sentence stays, be it empty."""

    def run(batches):
        for batch in batches:
            words, sizes = [], []
            for w, n in zip(batch.column(1), batch.column(2), strict=True):
                w, n = np.frombuffer(w.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int32)
                keep = known.value[w]
                words.append(w[keep].tobytes())
                sizes.append(np.add.reduceat(keep, np.cumsum(n) - n).astype(np.int32).tobytes() if len(n) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], ["grade", "words", "sizes"])

    return run


def fit_noisy_or(words: np.ndarray, sizes: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray, bits: int, rounds: int = 250, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) by full-batch Adam on the weighted log loss of the noisy-or.

    ``words``: hashed features of all sentences in order; ``sizes``: features per
    sentence; ``doc``: its document, rising; every document has a sentence.
    """
    sentence, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
    begin = np.searchsorted(doc, np.arange(len(label)))
    w = np.zeros((1 << bits) + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[words], minlength=n) + w[-1]
        hazard = np.maximum(np.add.reduceat(_softplus(z), begin), 1e-9)
        # loss = -y log(1 - exp(-hazard)) + (1 - y) hazard
        slope = weight * np.where(label == 1, -1 / np.expm1(np.minimum(hazard, 500)), 1.0)
        g_z = slope[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(words, g_z[sentence], minlength=1 << bits) + decay * len(label) * w[:-1], g_z.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


#: The score that is to part the labels best, and how low the noisy-or that becomes it may be.
CUT, LOWEST = 0.7, 0.25


def document_scores(z: np.ndarray, doc: np.ndarray, n: int, bias: float) -> np.ndarray:
    """The noisy-or of each document from its sentences' logits, each less a quiet sentence's hazard."""
    hazard = np.maximum(_softplus(z) - _softplus(max(bias, np.log(QUIET / (1 - QUIET)))), 0)
    return -np.expm1(-np.bincount(doc, hazard, minlength=n))


def _odds(p: float) -> float:
    return p / (1 - p)


def odds_factor(words: np.ndarray, sizes: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray, bits: int) -> float:
    """What the odds of scores are multiplied by, so that the score of the best F1 on documents that a fit left out becomes CUT."""
    n = len(label)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    score = np.zeros(n)
    for half in (0, 1):
        learn = np.arange(n) % 2 != half
        if len(set(label[learn].tolist())) < 2:
            return 1.0
        own, place = learn[doc], np.cumsum(learn) - 1
        w = fit_noisy_or(words[own[sentence]], sizes[own], place[doc[own]], label[learn], weight[learn], bits)
        z = np.bincount(sentence, w[words], minlength=len(sizes)) + w[-1]
        score[~learn] = document_scores(z, doc, n, float(w[-1]))[~learn]
    by = np.argsort(-score, kind="stable")
    score, y, weight = score[by], label[by], weight[by]
    caught, wrong = np.cumsum(weight * y), np.cumsum(weight * (1 - y))
    f1 = 2 * caught / (caught + wrong + (weight * y).sum())
    f1[:-1][score[1:] == score[:-1]] = 0  # equal scores are on one side
    best = int(np.argmax(f1))
    between = (score[best] + (score[best + 1] if best + 1 < n else 0)) / 2
    return _odds(CUT) / _odds(min(max(between, LOWEST), CUT))


def _within(bags: DataFrame, most: int) -> DataFrame:
    """Of each label the first bags, by a hash of what they hold, until they have ``most`` sentences together; the one that gets there is in."""
    kept = F.lit(False)
    key = F.xxhash64("words", "sizes")
    sized = sorted(tuple(r) for r in bags.select("grade", key.alias("key"), (F.length("sizes") / 4).cast("long").alias("n")).collect())
    for grade in {r[0] for r in sized}:
        own = [r for r in sized if r[0] == grade]
        at = min(int(np.searchsorted(np.cumsum([r[2] for r in own]), most)), len(own) - 1)
        kept |= (F.col("grade") == grade) & (key <= own[at][1])
    return bags.where(kept)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, bits: int = 18, per_label: int = 4000, max_sentences: int = 1_000_000) -> np.ndarray | None:
    """Fits the model on at most ``per_label`` documents of each ``labels.toxic`` value, of any length, and about ``max_sentences`` sentences.

    The sample is weighted back to the labels' shares. Features that don't tell
    the labels apart (``telling``) are left out: they would only memorise single
    documents, and what is left is small enough for the driver. Texts without
    words teach nothing. None if one of the two labels is missing. The model is
    a weight for each feature, the bias, and the factor of the odds of scores.
    """
    rows, totals = labelled_sample(docs, labels, F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0), per_label, None)
    if not totals.get(0) or not totals.get(1):
        return None
    schema = "grade int, words binary, sizes binary"
    bags = _within(saved(rows.mapInArrow(_bags(bits), schema).where("length(words) > 0"), "bags"), max_sentences)
    known = docs.sparkSession.sparkContext.broadcast(telling(bags, bits))
    got = bags.mapInArrow(_told(known), schema).toArrow()
    order = sorted(zip(got["grade"].to_pylist(), got["words"].to_pylist(), got["sizes"].to_pylist(), strict=True))
    label = np.array([x[0] for x in order])
    if len(set(label.tolist())) < 2:
        return None
    words = np.frombuffer(b"".join(x[1] for x in order), np.int32)
    each = [np.frombuffer(x[2], np.int32) for x in order]
    sizes = np.concatenate(each).astype(_I64)
    doc = np.repeat(np.arange(len(order)), [len(x) for x in each])
    drawn = np.bincount(label, minlength=2)
    share = np.array([totals[0], totals[1]]) / (totals[0] + totals[1]) / drawn
    weight = share[label] * len(label)
    return np.append(fit_noisy_or(words, sizes, doc, label, weight, bits), odds_factor(words, sizes, doc, label, weight, bits)).astype(np.float32)


def _scored(model, bits: int, cut: float):
    def run(batches):
        w = model.value
        for batch in batches:
            at = 0
            for p in pieces(batch.column(1), lower=True, marks=True):
                n = p.last - p.first
                score = np.zeros(n)
                found: list[list[dict]] = [[] for _ in range(n)]
                if len(p.hashes) and w is not None:
                    first, doc = sentences(p)
                    bias, factor = float(w[-2]), float(w[-1])
                    z = np.add.reduceat(w[_indices(p, bits)].astype(float), FORMS * first) + bias
                    score = document_scores(z, doc, n, bias)
                    score = factor * score / (1 - score + factor * score)
                    last = np.append(first[1:], len(p.hashes)) - 1
                    for s in np.flatnonzero(z >= np.log(cut / (1 - cut))).tolist():
                        text = bytes(p.data[p.starts[first[s]] : p.ends[last[s]]]).decode(errors="replace")
                        found[doc[s]].append({"sentence": text, "score": float(1 / (1 + np.exp(-z[s])))})
                kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.clip(score, 0, 1)), pa.array(found, kind)], ["row", "score", "offending"])
                at += n

    return run


def score_toxicity(docs: DataFrame, model: np.ndarray | None, text_col: str = "text", *, bits: int = 18, cut: float = 0.5) -> DataFrame:
    """``docs`` plus score (noisy-or of the sentences, 0 to 1) and offending: its sentences that score at least ``cut``.

    A sentence adds to the noisy-or what it has over a quiet one (``QUIET``).
    Null, empty and wordless texts score 0, as all do without a model; texts of
    any length are scored whole. Rows are scored alone: ids may be null or
    repeated. All columns pass through but those named score or offending, which
    are replaced; an empty table gives no rows. The model (a fixed 2**bits
    weights) is broadcast.
    """
    others = others_of(docs, "score", "offending")
    rows = docs.select(row_of(others), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scored(shared, bits, cut), row_and(rows, "score double, offending array<struct<sentence:string,score:double>>"))
    return out.select(*fields_of(others), "score", "offending")
