"""Quality rules on repetition, from a suffix array over the words of each document.

The suffixes of all documents of a piece are sorted together by doubling: a
round orders those still tied by the rank of what follows, so only repeated
text takes part in later rounds. The ranks kept of each round give the longest
common prefix of neighbours. A suffix's larger neighbour value is that of the
deepest LCP interval that holds it, so these spans are the occurrences of the
maximal repeated substrings; their union is the repeated part of a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fields_of, others_of, row_and, row_of
from .words import U64, Piece, mix, pieces

_I64 = np.int64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeat_lengths(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word the length in words of the longest run from it that also starts elsewhere in its document."""
    n = len(hashes)
    longest = np.zeros(n, _I64)
    if not n:
        return longest
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][doc]
    _, inverse, count = np.unique(hashes ^ mix(doc.astype(U64) + U64(1)), return_inverse=True, return_counts=True)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    rank = first[inverse]
    levels, h = [rank], 1
    active = np.flatnonzero(count[inverse] > 1)
    touched = active
    while len(active):
        then = active + h
        follow = np.where(then < end[active], rank[np.minimum(then, n - 1)], -1)
        by = np.lexsort((follow, rank[active]))
        own, r, f = active[by], rank[active][by], follow[by]
        group = np.flatnonzero(np.diff(r, prepend=-1))  # ties of the rank so far
        new = np.ones(len(own), bool)
        new[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
        head = np.flatnonzero(new)
        size = np.diff(head, append=len(own))
        base = np.repeat(group, np.diff(group, append=len(own)))
        rank = rank.copy()
        rank[own] = r + np.repeat(head, size) - base
        levels.append(rank)
        active = np.sort(own[np.repeat(size, size) > 1])
        h *= 2
    order = touched[np.argsort(rank[touched])]  # the suffix array, of suffixes whose first word recurs
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), _I64)
    for k in range(len(levels) - 1, -1, -1):
        on = np.flatnonzero((a < n) & (b < n))
        on = on[(a[on] < end[order[on]]) & (b[on] < end[order[on + 1]]) & (doc[order[on]] == doc[order[on + 1]])]
        on = on[levels[k][a[on]] == levels[k][b[on]]]
        common[on] += 1 << k
        a[on] += 1 << k
        b[on] += 1 << k
    np.maximum.at(longest, order[:-1], common)
    np.maximum.at(longest, order[1:], common)
    return longest


def _union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=_I64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _dup_lines(p: Piece) -> list[int]:
    out = []
    for a, b in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True):
        lines = [x for x in bytes(p.data[a:b]).split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        out.append(len(lines) - len(set(lines)))
    return out


def _measured(min_words: int):
    def run(batches):
        for batch in batches:
            at = 0
            for p in pieces(batch.column(1)):
                n, total = p.last - p.first, len(p.hashes)
                m = repeat_lengths(p.hashes, p.bounds)
                again = np.flatnonzero(m >= 3)
                deep = np.flatnonzero(m >= min_words)
                three, covered = _union(again, m[again], total), _union(deep, m[deep], total)
                chars = np.concatenate(([0], np.cumsum((p.data & 0xC0) != 0x80)))
                longest = np.zeros(n, _I64)
                if total:
                    full = np.flatnonzero(np.diff(p.bounds))
                    longest[full] = np.maximum.reduceat(m, p.bounds[full])
                spans = []
                turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
                for a, b in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True):
                    own = np.flatnonzero(np.diff(covered[a:b].astype(np.int8), prepend=0, append=0)).tolist() if len(turns) else []
                    spans.append([{"start": x, "end": y} for x, y in zip(own[::2], own[1::2], strict=True)])
                columns = [np.diff(p.bounds), _per_doc(chars[p.ends] - chars[p.starts], p.bounds), _per_doc(_SYMBOL[p.data], p.offsets), _dup_lines(p), _per_doc(three, p.bounds), _per_doc(covered, p.bounds), longest]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(x, pa.int64()) for x in columns), pa.array(spans, kind)], ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "spans"])
                at += n

    return run


def repetition_rules(docs: DataFrame, text_col: str = "text", *, min_words: int = 6, max_fraction: float = 0.25, max_repeat: int = 50) -> DataFrame:
    """``docs`` without its text column, plus counts, spans and verdicts per row.

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``),
    n_dup_lines (lines with a word that equal an earlier line), n_repeat_words
    (words in 3-word windows found twice or more), covered_words (words of
    maximal repeats of at least ``min_words`` words, as ``spans`` of word
    positions), longest_repeat (words), base_failed (fewer than 50 words, or
    more than half are n_repeat_words) and kept: false if base_failed, if more
    than ``max_fraction`` of the words is covered, or if a repeat is longer than
    ``max_repeat``. Null and empty texts have no words and fail; texts of any
    length are judged whole. Rows are judged alone, so repeated rows get equal
    results; ids are not used; all other columns pass through but those named
    like a new one, which are replaced; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    others = others_of(docs, text_col, *names, "spans", "base_failed", "kept")
    rows = docs.select(row_of(others), F.col(text_col).cast("string").alias("text"))
    schema = row_and(rows, ", ".join(f"{x} long" for x in names) + ", spans array<struct<start:long,end:long>>")
    out = rows.mapInArrow(_measured(min_words), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= max_fraction * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return out.select(*fields_of(others), *names, "spans", failed.alias("base_failed"), (~failed & fine).alias("kept"))
