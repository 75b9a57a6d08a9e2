"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of hashed-text weights is shared by all grades; ordered thresholds
cut its value into grades: P(grade > k) = logistic(z - threshold[k]). The model
gives the expected grade and the tail probabilities that selection uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .storage import fields_of, named, others_of, row_and, row_of
from .words import U64, Piece, mix, pieces

_I64 = np.int64
#: Bytes by what they are: letters a, capitals A, digits 0, others themselves.
_CLASS = np.array([65 if 65 <= b <= 90 else 97 if b >= 128 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint64)


def features(p: Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, doc) of hashed features: words, how words begin and end, pairs of such forms, repeats of the last word, and length."""
    n, h = len(p.hashes), p.hashes
    doc = np.repeat(np.arange(len(p.bounds) - 1), np.diff(p.bounds))
    first, last = _CLASS[p.data[p.starts]], _CLASS[p.data[p.ends - 1]]
    before = _CLASS[p.data[np.maximum(p.ends - 2, p.starts)]]
    form = mix(first << U64(16) | before << U64(8) | last | U64(1 << 32))
    same = np.zeros(n, bool)
    same[1:] = doc[1:] == doc[:-1]
    pair = mix(form[1:] + mix(form[:-1]))[same[1:]]
    again = np.where(h[1:] == h[:-1], U64(0x1234567), U64(0x7654321))[same[1:]]
    long = np.diff(p.bounds)
    length = mix(U64(1 << 40) + np.log2(np.maximum(long, 1)).astype(U64))
    parts = [h, form, pair, mix(again)]
    docs = [doc, doc, doc[1:][same[1:]], doc[1:][same[1:]]]
    index = np.concatenate([*parts, length])
    return (index >> U64(64 - bits)).astype(np.int32), np.concatenate([*docs, np.arange(len(long))])


def sums(index: np.ndarray, doc: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Mean weight of each document's features, times 16."""
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    return 16 * np.bincount(doc, weights[index], minlength=n) / count


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade above grades[k]) for each k but the last."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(index: np.ndarray, doc: np.ndarray, grade: np.ndarray, weight: np.ndarray, levels: int, bits: int, rounds: int = 80, rate: float = 0.5, decay: float = 1e-4, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient descent with momentum on the weighted log loss; grades are 0 to levels-1.

    Features of fewer than ``least`` documents keep weight 0.
    Thresholds stay in order: they are a first one and exponentials of steps.
    """
    n, size = len(grade), 1 << bits
    scale = 16 / np.maximum(np.bincount(doc, minlength=n), 1)
    x = np.zeros(size + levels - 1)
    x[size] = -1.0
    pairs, count = np.unique(index.astype(_I64) + doc.astype(_I64) * size, return_counts=True)
    index, doc = pairs % size, pairs // size
    known = np.append(np.bincount(index, minlength=size) >= least, np.ones(levels - 1, bool))
    keep = known[index]
    index, doc, count = index[keep], doc[keep], count[keep].astype(float)
    m, v = np.zeros_like(x), 0.0
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate((x[size : size + 1], np.exp(x[size + 1 :]))))
        z = scale * np.bincount(doc, x[index] * count, minlength=n)
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -60, 60)))
        full = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), 1)
        low, high = full[rows, grade], full[rows, grade + 1]
        p = np.maximum(low - high, 1e-9)
        slope = np.concatenate((np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))), 1)
        d_low, d_high = slope[rows, grade], slope[rows, grade + 1]
        g_z = -weight * (d_low - d_high) / p
        g_cut = np.zeros(levels + 1)
        np.add.at(g_cut, grade, weight * d_low / p)
        np.add.at(g_cut, grade + 1, -weight * d_high / p)
        g_cut = g_cut[1:levels]
        g_steps = np.array([g_cut[k:].sum() for k in range(levels - 1)])
        g_steps[1:] *= np.exp(x[size + 1 :])
        g = np.concatenate((np.bincount(index, (g_z * scale)[doc] * count, minlength=size) + decay * n * x[:size], g_steps / 4)) * known
        m, v = 0.9 * m + 0.1 * g, 0.9 * v + 0.1 * float(np.abs(g).max()) ** 2
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.9**t)) + 1e-8)
    return x[:size], np.cumsum(np.concatenate((x[size : size + 1], np.exp(x[size + 1 :]))))


def _featured(bits: int):
    def run(batches):
        for batch in batches:
            at = 0
            for p in pieces(batch.column(1)):
                n = p.last - p.first
                index, doc = features(p, bits)
                by = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[by], np.arange(n + 1)).tolist()
                index = index[by]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([index[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["grade", "index"])
                at += n

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, grade, *, bits: int = 18, per_grade: int = 1500, max_chars: int = 20_000) -> OrdinalModel | None:
    """Fits on at most ``per_grade`` documents of each grade (integer column over ``labels``, at most 64 grades), of at most ``max_chars`` characters.

    The sample is weighted back to the grades' shares, but no grade to less than
    a tenth of the most frequent one's. None with fewer than two grades.
    """
    rows, totals = labelled_sample(docs, labels, grade, per_grade, max_chars)
    got = rows.mapInArrow(_featured(bits), "grade int, index binary").toArrow()
    order = sorted(zip(got["grade"].to_pylist(), got["index"].to_pylist(), strict=True))
    grades = sorted({g for g, _ in order})
    if len(grades) < 2:
        return None
    place = np.array([grades.index(g) for g, _ in order])
    each = [np.frombuffer(x, np.int32) for _, x in order]
    doc = np.repeat(np.arange(len(order)), [len(x) for x in each])
    share = np.array([totals[g] for g in grades], float)
    share = np.maximum(share, share.max() / 10) / np.bincount(place)
    weight = share[place] / share[place].mean()
    weights, cuts = fit_ordinal(np.concatenate(each), doc, place, weight, len(grades), bits)
    return OrdinalModel(grades, weights.astype(np.float32), cuts)


def _graded(shared, bits: int):
    def run(batches):
        model = shared.value
        for batch in batches:
            at = 0
            for p in pieces(batch.column(1)):
                n = p.last - p.first
                index, doc = features(p, bits)
                tails = model.tails(sums(index, doc, model.weights, n))
                steps = np.diff(np.array(model.grades, float))
                expected = model.grades[0] + tails @ steps
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(expected), pa.array(tails.tolist(), pa.list_(pa.float64()))], ["row", "expected_grade", "tails"])
                at += n

    return run


def grade_quality(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", *, bits: int = 18) -> DataFrame:
    """``docs`` plus expected_grade (double) and tails: P(grade above the k-th grade) for each grade but the highest.

    Null and empty texts are graded by their length feature alone, texts of any
    length whole. Without a model both are null. Rows are graded alone: ids may
    be null or repeated. All columns pass through but those named like a new
    one, which are replaced; an empty table gives no rows. The model (a fixed
    2**bits weights) is broadcast.
    """
    others = others_of(docs, "expected_grade", "tails")
    if model is None:
        return docs.select(*map(named, others), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tails"))
    rows = docs.select(row_of(others), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_graded(shared, bits), row_and(rows, "expected_grade double, tails array<double>"))
    return out.select(*fields_of(others), "expected_grade", "tails")
