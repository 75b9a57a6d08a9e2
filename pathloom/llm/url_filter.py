"""URL filters: host and path rules, and for the rest a character language-model ratio.

Two variable-order Markov models of host and path are counted over all URLs
that rules accept and reject. Of every URL, counted or scored, the parts that
rules tell apart are left out, the same for all: as many last labels of the host
as the shortest rule's host has, and as many first segments of the path as the
longest rule's path has. They made the labels, and would be all that is learnt.
The probability of a character interpolates the orders by Witten-Bell: the longer a
context is seen, the more it counts. Both models rest on one distribution of
characters, that of all these URLs, so a character that one side lacks does not
decide alone. A URL's score is the difference of the two log likelihoods a
character; the least score that is accepted is calibrated on decided URLs that
the counts leave out; of equally good ones it is that nearest to 0, where both
models say the same.

A gram is a byte with the bytes before it, packed into a number, so counts are
exact. They are kept in a table that grows with the input: the ratio of each
gram that occurs is computed by joins, order by order, and texts are scored in
chunks of about the same size, each with the ratios of its own grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fields_of, others_of, row_of, saved
from .words import texts_of

Rule = tuple[str, str, str]  # verdict, host, path
_CALIBRATION = 5  # one URL in so many, by hash, is for calibration
_SPAN, _STEPS = 8.0, 1600
#: Bits of the character and of each byte before it in a gram: a byte plus 1, or 0 before the start.
_CHARACTER, _BACK = 8, 9
#: The longest context that a 64-bit gram holds.
MOST_ORDERS = 6
#: Bytes of the texts that are scored together.
CHUNK = 1 << 20


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule whose host is the host or a parent of it and whose path begins the path; else nulls.

    Of rules of one length the last in order of verdict, host and path counts.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        text, verdict = F.when(fits, own + prefix).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def read_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """What the models read of a URL: host and path without the parts that rules tell apart."""
    labels = min((own.count(".") + 1 for _, own, _ in rules), default=0)
    segments = max((len([x for x in prefix.split("/") if x]) for _, _, prefix in rules), default=0)
    kept_host = F.regexp_replace(host, r"(?:(?:^|\.)[^.]*){%d}\z" % labels, "") if labels else host
    return F.concat(kept_host, F.lit("/"), F.regexp_replace(path, r"^/*(?:[^/]*/+|[^/]*\z){0,%d}" % segments, ""))


def _grams(column: pa.Array, orders: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The gram of every byte with the ``orders`` bytes before it, and each byte's row; the character has the lowest bits, then the nearest byte."""
    texts = texts_of(column)
    n = len(texts)
    _, place, body = texts.buffers()
    offsets = np.frombuffer(place, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    data = data.astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    since = np.arange(len(data)) - (offsets[:-1] - offsets[0])[row]
    gram = data.copy()
    for k in range(1, orders + 1):
        back = np.zeros(len(data), np.int64)
        back[k:] = data[:-k] + 1
        gram |= np.where(since >= k, back, 0) << (_CHARACTER + _BACK * (k - 1))
    return row, gram, n


def _counted(orders: int):
    """(text, n0, n1) to (gram, c0, c1): how often a gram is in rejected and in accepted URLs of a batch."""

    def run(batches):
        for batch in batches:
            row, gram, _ = _grams(batch.column(0), orders)
            key, at = np.unique(gram, return_inverse=True)
            sums = [np.bincount(at, batch.column(k).to_numpy(zero_copy_only=False)[row], minlength=len(key)).astype(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums[0]), pa.array(sums[1])], ["gram", "c0", "c1"])

    return run


def _occurring(orders: int):
    """(chunk, text) to the distinct (chunk, gram) of a batch."""

    def run(batches):
        for batch in batches:
            row, gram, _ = _grams(batch.column(1), orders)
            chunk = batch.column(0).to_numpy()[row]
            by = np.lexsort((gram, chunk))
            chunk, gram = chunk[by], gram[by]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (chunk[1:] != chunk[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(chunk[new]), pa.array(gram[new])], ["chunk", "gram"])

    return run


def count_grams(texts: DataFrame, *, orders: int = 5) -> DataFrame:
    """Exact (gram, c0, c1) over ``texts`` (text, n0, n1: how many rejected and accepted URLs have it)."""
    if orders > MOST_ORDERS:
        raise ValueError(f"at most {MOST_ORDERS} orders")
    rows = texts.select("text", F.col("n0").cast("long"), F.col("n1").cast("long")).mapInArrow(_counted(orders), "gram long, c0 long, c1 long")
    return rows.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def gram_ratios(counts: DataFrame, asked: DataFrame, *, orders: int = 5) -> DataFrame:
    """(gram, ratio) of each gram of ``asked``: the log of its character's probability after its context in accepted URLs over that in rejected ones."""
    known = None
    for k in range(orders + 1):
        # The gram of order k is the low end of a longer one; its context is that without the character.
        ends = F.col("gram").bitwiseAND((1 << (_CHARACTER + _BACK * k)) - 1)
        pairs = counts.groupBy(ends.alias("gram")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        context = F.shiftright("gram", _CHARACTER).alias("context")
        contexts = pairs.groupBy(context).agg(*(F.sum(f"c{s}").alias(f"s{s}") for s in (0, 1)), *(F.count_if(F.col(f"c{s}") > 0).alias(f"t{s}") for s in (0, 1)))
        now = asked.select(ends.alias("gram")).distinct().select("gram", context).join(pairs, "gram", "left").join(contexts, "context", "left")
        if known is None:
            all_ = F.coalesce(F.col("c0") + F.col("c1"), F.lit(0)) + 1
            now = now.withColumn("q0", all_ / (F.coalesce(F.col("s0") + F.col("s1"), F.lit(0)) + 256)).withColumn("q1", F.col("q0"))
        else:
            shorter = F.col("gram").bitwiseAND((1 << (_CHARACTER + _BACK * (k - 1))) - 1)
            # Up to order 1 there are at most 257 * 256 grams, whatever the input.
            known = known.select(F.col("gram").alias("end"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            now = now.withColumn("end", shorter).join(F.broadcast(known) if k <= 2 else known, "end")
        mixed = [F.when(F.col(f"t{s}") > 0, (F.coalesce(f"c{s}", F.lit(0)) + F.col(f"t{s}") * F.col(f"q{s}")) / (F.col(f"s{s}") + F.col(f"t{s}"))).otherwise(F.col(f"q{s}")).alias(f"p{s}") for s in (0, 1)]
        known = now.select("gram", *mixed)
    return known.select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))


def _chunk_scores(orders: int):
    """Texts of a chunk and the ratios of its grams to (text, score)."""

    def run(texts: pa.Table, ratios: pa.Table) -> pa.Table:
        column = texts["text"].combine_chunks()
        row, gram, n = _grams(column, orders)
        key, ratio = ratios["gram"].to_numpy(), ratios["ratio"].to_numpy()
        by = np.argsort(key)
        value = ratio[by][np.searchsorted(key[by], gram)] if len(gram) else np.empty(0)
        score = np.bincount(row, value, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
        return pa.table({"text": column, "score": pa.array(score, pa.float64())})

    return run


def score_texts(texts: DataFrame, counts: DataFrame, size: int, *, orders: int = 5) -> DataFrame:
    """(text, score) of distinct ``texts`` of ``size`` bytes together: the mean ratio of the grams; an empty text scores 0."""
    chunk = F.pmod(F.xxhash64("text", F.lit(29)), F.lit(-(-size // CHUNK) or 1)).cast("long")
    dealt = texts.select(chunk.alias("chunk"), "text")
    occurring = saved(dealt.mapInArrow(_occurring(orders), "chunk long, gram long").distinct(), "grams")
    ratios = occurring.join(gram_ratios(counts, occurring, orders=orders), "gram").select("chunk", "gram", "ratio")
    return dealt.groupBy("chunk").cogroup(ratios.groupBy("chunk")).applyInArrow(_chunk_scores(orders), "text string, score double")


def calibrated(scored: DataFrame) -> float:
    """The least score to accept, by the best mean of both sides' hit rates, of equally good ones that nearest to 0, from a histogram of (score, n0, n1) of fixed size."""
    step = F.least(F.greatest(F.floor((F.col("score") + _SPAN) * (_STEPS / (2 * _SPAN))), F.lit(0)), F.lit(_STEPS - 1)).cast("int")
    bins = np.zeros((2, _STEPS))
    for r in scored.groupBy(step.alias("step")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        bins[:, r["step"]] = r["n0"], r["n1"]
    if not bins.sum(1).all():
        return 0.0
    good = 1 - np.concatenate(([0], np.cumsum(bins[1]))) / bins[1].sum() + np.concatenate(([0], np.cumsum(bins[0]))) / bins[0].sum()
    best = np.flatnonzero(good >= good.max() - 1e-12) * 2 * _SPAN / _STEPS - _SPAN
    return float(best[np.argmin(np.abs(best))])


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", *, orders: int = 5) -> DataFrame:
    """``pages`` plus host, path, rule (text or null), score and verdict (allow or block).

    The verdict is the longest fitting rule's, else ``allow`` if the score
    reaches the calibrated one. Null URLs and those without ``://`` have an
    empty host and path and score 0. Where the rules leave one side without
    URLs there is nothing to compare: scores are 0 and all are allowed. URLs of
    any length are taken whole. Rows are judged alone; ids may be null or repeated;
    all columns pass through but those named like a new one, which it replaces;
    an empty table gives no rows. Rules are compiled into the plan: keep them
    to some hundreds.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    others = others_of(pages, "host", "path", "rule", "score", "verdict")
    rows = pages.select(row_of(others), host.alias("host"), path.alias("path"))
    rows = rows.select("row", "host", "path", rule.alias("rule"), verdict.alias("verdict"), read_of(F.col("host"), F.col("path"), rules).alias("text"))
    apart = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(_CALIBRATION)) == 0
    texts = rows.groupBy("text").agg(F.count_if(F.col("verdict") == "block").alias("n0"), F.count_if(F.col("verdict") == "allow").alias("n1"))
    texts = saved(texts.withColumn("apart", apart), "texts")
    fitted = [F.coalesce(F.sum(F.when(~F.col("apart") & (F.col("text") != ""), F.col(n))), F.lit(0)).alias(n) for n in ("n0", "n1")]
    seen = texts.agg(*fitted, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    if not seen["n0"] or not seen["n1"]:
        out, least = rows.withColumn("score", F.lit(0.0)), 0.0
    else:
        counts = saved(count_grams(texts.where(~F.col("apart") & (F.col("n0") + F.col("n1") > 0)), orders=orders), "counts")
        scores = saved(score_texts(texts, counts, seen["size"], orders=orders), "scores")
        least = calibrated(scores.join(texts.where(F.col("apart") & (F.col("n0") + F.col("n1") > 0)), "text").select("score", "n0", "n1"))
        out = rows.join(scores, "text")
    return out.select(*fields_of(others), "host", "path", "rule", "score", F.coalesce("verdict", F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"))
