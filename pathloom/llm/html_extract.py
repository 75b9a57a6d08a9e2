"""The main text of pages by a linear-chain conditional random field over their leaf blocks.

Each block is main text or not. What speaks for it are weights of its features
(ancestors, text, links); what speaks for the sequence are weights of the steps
from label to label, apart for steps within one parent. Weights maximise the
likelihood of labelled pages; the best sequence is found by Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks_of, features
from .page_layouts import MAIN, OTHER, labelled_page
from .storage import fields_of, named, others_of, row_and, row_of

#: Blocks of these ancestors are no main text of an article, wherever they stand in it.
_NEVER = frozenset({"in:aside", "in:footer", "in:form", "in:nav", "at:advert", "at:talk", "at:notice"})
#: Pages of a slice whose results are handed on together.
_SLICE = 256


@dataclass
class ChainModel:
    """weights: of a block to be main text. steps[s][a][b]: from label a to label b, s: within one parent. ends[0], ends[1]: of the first and the last block to be main text."""

    weights: dict[str, float]
    steps: list[list[list[float]]]
    ends: list[float]

    def scores(self, blocks: list[Block], cache: dict) -> list[float]:
        """What each block's features say for main text. ``cache`` holds the sums of places."""
        out, w = [], self.weights
        for place, own in features(blocks):
            score = cache.get(place)
            if score is None:
                score = cache[place] = sum(w.get(f, 0.0) for f in place)
            out.append(score + sum(w.get(f, 0.0) for f in own))
        return out

    def decode(self, scores: list[float], same: list[bool]) -> list[bool]:
        """The best sequence of labels; at a tie a block is main text, and the last label decides before those it follows. same[i]: block i has the parent of the one before."""
        if not scores:
            return []
        no, yes = 0.0, scores[0] + self.ends[0]
        back: list[tuple[bool, bool]] = []
        for score, s in zip(scores[1:], same[1:], strict=True):
            (nn, ny), (yn, yy) = self.steps[s]
            from_no, from_yes = no + nn, yes + yn
            back_no = from_yes >= from_no
            up_no, up_yes = no + ny, yes + yy
            back_yes = up_yes >= up_no
            no, yes = (from_yes if back_no else from_no), (up_yes if back_yes else up_no) + score
            back.append((back_no, back_yes))
        label = yes + self.ends[1] >= no
        out = [label]
        for before in reversed(back):
            label = before[label]
            out.append(label)
        return out[::-1]


def same_parent(blocks: list[Block]) -> list[bool]:
    return [i > 0 and blocks[i - 1].parent == b.parent for i, b in enumerate(blocks)]


def fit_chain(pages: list[tuple[list[tuple[frozenset, tuple[str, ...]]], list[bool], list[bool]]], *, most: int = 64, rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> ChainModel:
    """Maximises the likelihood of labelled pages, each (features, same, labels) of its blocks, by gradients from the forward-backward sums of all pages at once.

    Pages of more than ``most`` blocks are not learned from.
    """
    pages = [p for p in pages if 0 < len(p[0]) <= most]
    names = sorted({f for fs, _, _ in pages for place, own in fs for f in (*place, *own)})
    place_of = {f: k for k, f in enumerate(names)}
    n, wide = len(pages), max((len(p[0]) for p in pages), default=0)
    feature, block, same, label = [], [], np.zeros((n, wide), int), np.zeros((n, wide), int)
    inside = np.zeros((n, wide), bool)
    for i, (fs, s, y) in enumerate(pages):
        same[i, : len(fs)], label[i, : len(fs)], inside[i, : len(fs)] = s, y, True
        for t, (above, own) in enumerate(fs):
            for f in {*above, *own}:
                feature.append(place_of[f])
                block.append(i * wide + t)
    feature, block = np.array(feature, int), np.array(block, int)
    size = len(names)
    x = np.zeros(size + 8 + 2)
    rows, last = np.arange(n), inside.sum(1) - 1
    moves = inside[:, 1:]
    seen = np.zeros_like(x)
    np.add.at(seen, feature, label.ravel()[block])
    np.add.at(seen, size + 4 * same[:, 1:][moves] + 2 * label[:, :-1][moves] + label[:, 1:][moves], 1)
    seen[-2], seen[-1] = label[:, 0].sum(), label[rows, last].sum()
    m, v = np.zeros_like(x), np.zeros_like(x)

    def both(a, b):
        return np.logaddexp(a, b)

    for k in range(1, rounds + 1):
        unary = np.zeros((n, wide, 2))
        unary[:, :, 1] = np.bincount(block, x[feature], minlength=n * wide).reshape(n, wide)
        unary[:, 0, 1] += x[-2]
        unary[rows, last, 1] += x[-1]
        step = x[size : size + 8].reshape(2, 2, 2)[same]  # n, wide, from, to
        ahead, behind = np.zeros((n, wide, 2)), np.zeros((n, wide, 2))
        ahead[:, 0] = unary[:, 0]
        for t in range(1, wide):
            here = both(ahead[:, t - 1, 0, None] + step[:, t, 0], ahead[:, t - 1, 1, None] + step[:, t, 1]) + unary[:, t]
            ahead[:, t] = np.where(inside[:, t, None], here, ahead[:, t - 1])
        for t in range(wide - 2, -1, -1):
            then = (behind[:, t + 1] + unary[:, t + 1])[:, None, :] + step[:, t + 1]
            behind[:, t] = np.where(inside[:, t + 1, None], both(then[:, :, 0], then[:, :, 1]), 0)
        whole = both(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(np.minimum(0, ahead + behind - whole[:, None, None])) * inside[:, :, None]
        pair = np.exp(np.minimum(0, ahead[:, :-1, :, None] + step[:, 1:] + (unary + behind)[:, 1:, None, :] - whole[:, None, None, None])) * moves[:, :, None, None]
        want = np.zeros_like(x)
        want[:size] = np.bincount(feature, p[:, :, 1].ravel()[block], minlength=size)
        for s in (0, 1):
            want[size + 4 * s : size + 4 * s + 4] = pair[same[:, 1:] == s].sum(0).ravel()
        want[-2], want[-1] = p[:, 0, 1].sum(), p[rows, last, 1].sum()
        g = (want - seen) / n + decay * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return ChainModel(dict(zip(names, x[:size].tolist(), strict=True)), x[size : size + 8].reshape(2, 2, 2).tolist(), x[-2:].tolist())


def marked(page: str) -> tuple[list, list[bool], list[bool]]:
    """A page with marked slots as (features, same, labels)."""
    found = blocks_of(page)
    labels = [MAIN in b.text for b in found]
    plain = [b._replace(text=b.text.replace(MAIN, "").replace(OTHER, "") or "-") for b in found]
    return features(plain), same_parent(plain), labels


def by_landmarks(page: str) -> tuple[list, list[bool], list[bool]] | None:
    """A page that names its article by an element, labelled by that; None if it doesn't, or names nothing else."""
    found = blocks_of(page)
    labels = ["in:article" in b.place.features and not b.place.features & _NEVER for b in found]
    return (features(found), same_parent(found), labels) if 0 < sum(labels) < len(labels) else None


def _without(page: str, *names: str) -> str:
    """The page with these elements turned into plain ones."""
    for name in names:
        page = page.replace(f"<{name}", "<div").replace(f"</{name}", "</div")
    return page


def fit_extraction(pages: DataFrame, html_col: str = "html", *, sample: int = 200, layouts: int = 600, max_chars: int = 50_000, seed: int = 11) -> ChainModel:
    """Fits on ``layouts`` labelled pages of known layout and at most ``sample`` pages of the table, of at most ``max_chars`` characters, drawn by their hash.

    A drawn page is labelled by its ``article`` element, if it has one, and
    counts three times: as it is, without that element, and without any
    landmark, so that text and links must tell as well. Its words fill the layouts.
    """
    html = F.col(html_col).cast("string")
    rows = pages.select(html.alias("html")).where(F.length("html") <= max_chars).select(F.xxhash64("html").alias("h"), "html")
    # Hashes are drawn first, so that tasks don't send pages that others outdo; of equal pages one is taken.
    drawn = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = rows.where(F.col("h") <= drawn[-1]).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect() if drawn else []
    learned, words = [], []
    for r in rows:
        words += [w for b in blocks_of(r["html"]) for w in b.text.split()[:50]][:400]
        own = by_landmarks(r["html"])
        if own:
            learned.append(own)
            for gone in (("article",), ("article", "main", "nav", "footer", "header", "aside")):
                again = blocks_of(_without(r["html"], *gone))
                if [b.text for b in again] == [b.text for b in blocks_of(r["html"])]:
                    learned.append((features(again), same_parent(again), own[2]))
    random = np.random.RandomState(seed)
    words = words or "a of the one that which two there".split()
    learned += [marked(labelled_page(random, words)) for _ in range(layouts)]
    return fit_chain(learned)


def extract_main(page: str, model: ChainModel, cache: dict) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of one page."""
    found = blocks_of(page)
    kept = [b.text for b, main in zip(found, model.decode(model.scores(found, cache), same_parent(found)), strict=True) if main]
    return " ".join(kept), len(found), len(kept)


def _extracted(shared):
    def run(batches):
        model, cache = shared.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                made = []
                for page in part.column("html"):
                    if len(cache) > 20_000:
                        cache.clear()
                    made.append(extract_main(page.as_py() or "", model, cache))
                text, blocks, kept = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(text, pa.string()), pa.array(blocks, pa.int64()), pa.array(kept, pa.int64())], ["row", "text", "n_blocks", "n_kept"])

    return run


def extract_text(pages: DataFrame, model: ChainModel, html_col: str = "html") -> DataFrame:
    """``pages`` without their HTML, plus text, n_chars (code points), n_blocks and n_kept.

    The text is that of the main blocks in page order, joined by one space.
    Null and empty pages, and those without text, have an empty one; pages are
    read whole, whatever their length, each alone: ids may be null or repeated.
    Other columns pass through but those named like a new one, which are
    replaced; an empty table gives no rows. The model, some hundred weights, is broadcast.
    """
    others = [c for c in others_of(pages, "text", "n_chars", "n_blocks", "n_kept") if c.lower() != html_col.lower()]
    rows = pages.select(row_of(others), named(html_col).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_extracted(shared), row_and(rows, "text string, n_blocks long, n_kept long"))
    return out.select(*fields_of(others), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
