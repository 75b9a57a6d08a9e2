"""Bounded samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, grade, per_grade: int, max_chars: int | None) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_grade`` labelled documents of each grade, and how many labelled ids each grade has.

    ``grade`` is an integer column over ``labels``, of at most 64 values. Ids
    are drawn by their hash (at a tie the smaller), whatever the size of the
    tables, from those that have a text of at most ``max_chars`` characters, if
    given; others are neither drawn nor counted. Null ids, texts and grades are
    left out; of an id with several grades the smallest counts, of one with
    several rows one is taken. Gives (grade, text) rows.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null" if max_chars is None else F.length("text") <= max_chars)
    graded = labels.select("doc_id", grade.cast("int").alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))
    graded = graded.join(texts.select("doc_id"), "doc_id", "left_semi")
    totals = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().limit(65).collect()}
    if len(totals) > 64:
        raise ValueError("more than 64 grades")
    parts = []
    for g in sorted(totals):
        part = graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        parts.append(part)
    if not parts:
        return docs.select(F.lit(0).alias("grade"), F.col("text").cast("string").alias("text")).limit(0), totals
    drawn = parts[0]
    for part in parts[1:]:
        drawn = drawn.union(part)
    # At most 64 * per_grade ids: the bound that lets them be broadcast.
    found = texts.join(F.broadcast(drawn), "doc_id")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return found.withColumn("_r", F.row_number().over(once)).where("_r = 1").select("grade", "text"), totals
