"""Removal of word passages that recur anywhere in a corpus, located by Aho-Corasick automata.

1. Anchors. Of the ``gram``-word runs in a window of ``window`` words the one
   with the smallest hash is the window's anchor, so equal windows have equal
   anchors, and a text has about two anchors per window length. Anchors that
   occur once in the corpus rule their windows out.
2. Confirmed passages. Windows around the recurring anchors are counted by
   hash; those that start twice or more anywhere are confirmed, and runs of
   them make recurring passages.
3. Automata. Every task streams its share of all documents. For each stretch
   of them it compiles one shard: an automaton of the passages confirmed for
   these documents, in pieces of one window, over an alphabet of word codes.
   The stretch is streamed through its automaton, every hit is checked by the
   window's 64-bit hash, and the hits' spans are united.

Equal texts are counted once by their hashes: all their windows recur.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fields_of, others_of, row_and, row_of, saved
from .words import U64, pieces, rolling, texts_of

_I64 = np.int64
#: Keys of texts that a task remembers, so as to describe equal ones once; beyond that they are only more work.
_SEEN = 200_000


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def _anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """(grams, low, valid): gram hashes, the smallest gram hash of the window that starts at each word, and whether a whole window does."""
    n = len(hashes)
    if n < window:
        return None
    grams = rolling(hashes, gram)
    low = _sliding(grams, window - gram + 1, np.minimum)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # words to the document's end
    return grams, low, left[: n - window + 1] >= window


def _described(window: int, gram: int):
    span = window - gram + 1

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for p in pieces(batch.column(2)):
                n = p.last - p.first
                found = _anchors(p.hashes, p.bounds, window, gram)
                lists: list[np.ndarray] = []
                ends = [0]
                chosen = np.empty(0, _I64)
                if found:
                    grams, low, valid = found
                    held = np.zeros(len(grams) + span - 1, U64)
                    held[span - 1 : span - 1 + len(low)] = np.where(valid, low, U64(0))
                    chosen = np.flatnonzero((_sliding(held, span, np.maximum) == grams) & (grams > 0))
                cut = np.searchsorted(chosen, p.bounds)
                for i in range(n):
                    own = chosen[cut[i] : cut[i + 1]]
                    key = int(keys[at + i])
                    if len(own) and key not in seen:
                        if len(seen) < _SEEN:
                            seen.add(key)
                        h = np.sort(grams[own])
                        lists.append(h[np.concatenate(([True, True], h[2:] != h[:-2]))[: len(h)]])  # each at most twice
                        ends.append(ends[-1] + len(lists[-1]))
                    else:
                        ends.append(ends[-1])
                flat = np.concatenate(lists).view(_I64) if lists else np.empty(0, _I64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.diff(p.bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["k1", "k2", "n", "anchors"])
                at += n

    return run


def _windows(window: int, gram: int):
    """(row, text, k1, k2, anchors) to the windows with one of these anchors: (k1, k2, pos, hash)."""

    def run(batches):
        seen: set[int] = set()  # one of equal texts stands for all: the others' windows recur as copies
        for batch in batches:
            keys, at = batch.column(2).to_numpy(zero_copy_only=False), 0
            for p in pieces(batch.column(1)):
                n = p.last - p.first
                found = _anchors(p.hashes, p.bounds, window, gram)
                if found:
                    low = found[1]
                    whole = rolling(p.hashes, window)
                    places, rows = [], []
                    for i in range(n):
                        a, b = int(p.bounds[i]), int(p.bounds[i + 1]) - window + 1
                        wanted = batch.column(4)[at + i].values
                        if b > a and wanted is not None and len(wanted) and int(keys[at + i]) not in seen:
                            if len(seen) < _SEEN:
                                seen.add(int(keys[at + i]))
                            own = np.flatnonzero(np.isin(low[a:b], wanted.to_numpy(zero_copy_only=False).view(U64))) + a
                            places.append(own)
                            rows.append(np.full(len(own), i, _I64))
                    if places:
                        place, row = np.concatenate(places), np.concatenate(rows)
                        pick = pa.array(row + at)
                        yield pa.RecordBatch.from_arrays([batch.column(2).take(pick), batch.column(3).take(pick), pa.array((place - p.bounds[row]).astype(np.int32)), pa.array(whole[place].view(_I64))], ["k1", "k2", "pos", "hash"])
                at += n

    return run


def _codes(hashes: np.ndarray) -> str:
    """One character per word, from 53,248 that are no surrogates."""
    return (hashes % U64(0xD000) + U64(0x100)).astype("<u2").tobytes().decode("utf-16-le")


def _located(window: int):
    def run(batches):
        for batch in batches:
            texts, at = texts_of(batch.column(1)), 0
            for p in pieces(texts):
                n = p.last - p.first
                whole = rolling(p.hashes, window)
                shard = ahocorasick.Automaton()
                for i in range(n):
                    own = batch.column(3)[at + i].values
                    if own is None or not len(own):
                        continue
                    starts = np.sort(own.to_numpy(zero_copy_only=False).astype(_I64)) + p.bounds[i]
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(starts) > 1) + 1, [len(starts)]))
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        first, last = int(starts[a]), int(starts[b - 1])
                        for s in [*range(first, last, window), last]:
                            key, h = _codes(p.hashes[s : s + window]), int(whole[s])
                            known = shard.get(key, ())
                            if h not in known:
                                shard.add_word(key, (*known, h))
                if len(shard):
                    shard.make_automaton()
                out = [[], [], [], []]
                for i in range(n):
                    a, b = int(p.bounds[i]), int(p.bounds[i + 1])
                    covered = np.zeros(b - a, bool)
                    if b - a >= window and (batch.column(2)[at + i].as_py() or 0) > 1:
                        covered[:] = True
                    elif b - a >= window and len(shard):
                        edge = np.zeros(b - a + 1, np.int32)
                        for end, hashes in shard.iter(_codes(p.hashes[a:b])):
                            if int(whole[a + end + 1 - window]) in hashes:
                                edge[end + 1 - window] += 1
                                edge[end + 1] -= 1
                        covered = np.cumsum(edge[:-1]) > 0
                    words = bytes(p.data[p.offsets[i] : p.offsets[i + 1]]).split()
                    turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
                    if turns:
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    out[0].append(b - a)
                    out[1].append(int(covered.sum()))
                    out[2].append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                    out[3].append(b" ".join(words).decode(errors="replace"))
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], spans), pa.array(out[3], pa.string())], ["row", "n_words", "n_removed", "spans", "kept"])
                at += n

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", *, window: int = 35, gram: int = 8) -> DataFrame:
    """``docs`` without its text column, plus n_words, n_removed (long), spans and kept.

    Words are runs of characters other than ``\\\\x20 \\\\x09-\\\\x0D``, unchanged. A word
    goes if a run of ``window`` words of its document that covers it also starts
    elsewhere, in any document, the same included; all occurrences go. spans
    are the removed runs as word positions (start, end), kept is what is left,
    joined by one space; bytes that are no UTF-8 become U+FFFD. Null, empty and
    short texts lose nothing (null counts as empty); texts of any length are searched whole. Repeated rows are copies
    of each other, and of equal passages all go, whichever is first. Ids are not
    used, so they may be null or repeated; all other columns pass through but
    those named like a new one, which are replaced. An empty table gives no rows.
    """
    others = others_of(docs, text_col, "n_words", "n_removed", "spans", "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_of(others), text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    described = rows.select("k1", "k2", "text").mapInArrow(_described(window, gram), "k1 long, k2 int, n long, anchors array<long>")
    described = saved(described, "anchors")
    copies = described.groupBy("k1", "k2").agg(F.count("*").alias("copies"))

    # The longest of the lists of equal texts: others of the same task are empty.
    one = described.where("size(anchors) > 0").dropDuplicates(["k1", "k2"])
    anchors = one.select("k1", "k2", F.explode("anchors").alias("anchor"))
    recurring = anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    wanted = anchors.join(recurring, "anchor", "left_semi").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors"))

    # All columns stay, though the windows need no "row": so this join and the last read one exchange of the texts.
    texts = rows.join(wanted, ["k1", "k2"]).select("row", "text", "k1", "k2", "anchors")
    found = texts.mapInArrow(_windows(window, gram), "k1 long, k2 int, pos int, hash long")
    # Counted on the map side first, and written: between two plain tables Spark splits a common window's rows over tasks.
    found = saved(found, "windows")
    again = saved(found.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash"), "again")
    found = found.join(again, "hash", "left_semi")
    confirmed = found.groupBy("k1", "k2").agg(F.collect_set("pos").alias("confirmed"))

    known = copies.where("copies > 1").join(confirmed, ["k1", "k2"], "full_outer").select("k1", "k2", "copies", "confirmed")
    joined = rows.join(known, ["k1", "k2"], "left").select("row", "text", "copies", "confirmed")
    out = joined.mapInArrow(_located(window), row_and(rows, "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"))
    return out.select(*fields_of(others), "n_words", "n_removed", "spans", "kept")
