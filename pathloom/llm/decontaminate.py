"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame operations only.

Short items are looked for in long documents, so sizes differ by orders of
magnitude and only the items are sketched. Items are partitioned by their
number of shingles; the sketch of an item is its k smallest shingle hashes,
where k for a partition is one more than the shingles that a contained item of
the partition may lack. So a document that contains an item holds a shingle of
its sketch: the search misses nothing. Document shingles above the largest
sketch hash are dropped before the lookup, and each (document, item) that it
finds is verified by the exact number of shared shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sketches and items of up to so many rows are broadcast (at most about 100 MB); beyond that they are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<long>"))


def _shingle(at: Column, width: int) -> Column:
    return F.xxhash64(*(F.get("wh", at + k) for k in range(width)))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", *, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, item, item_shingles, found, containment) of each document that contains an item.

    Words are runs of letters and digits, lower-cased; an item's set is its
    distinct ``width``-word shingles (a shorter item is one shingle of all its
    words, looked for as such). It is contained when den * found >= num *
    item_shingles. Null, empty and wordless texts contain nothing and are in
    nothing; texts of any length are searched whole. Repeated rows give one
    result; a null id is a value like others; of an id with several texts an
    item's best find counts. Other columns are ignored; empty tables give no
    rows. Shingles are compared by 64-bit hashes.
    """
    items = items.select(F.col(item_col).alias("item"), _word_hashes(F.col(text_col)).alias("wh")).where("size(wh) > 0")
    widths = sorted(r[0] for r in items.select(F.least(F.size("wh"), F.lit(width)).alias("m")).distinct().collect())
    key_type = docs.schema[id_col].dataType.simpleString()
    if not widths:
        return docs.sparkSession.createDataFrame([], f"{id_col} {key_type}, {item_col} {items.schema['item'].dataType.simpleString()}, item_shingles long, found long, containment double")
    parts = []
    for m in widths:  # at most ``width`` of them
        own = items.where((F.size("wh") == m) if m < width else (F.size("wh") >= m))
        own = own.select("item", "wh", F.explode(F.sequence(F.lit(0), F.size("wh") - m)).alias("at"))
        parts.append(own.select("item", F.lit(m).alias("m"), _shingle(F.col("at"), m).alias("h")))
    shingles = parts[0]
    for part in parts[1:]:
        shingles = shingles.union(part)
    shingles = shingles.distinct()
    by_item = Window.partitionBy("item")
    shingles = shingles.withColumn("n", F.count("*").over(by_item)).withColumn("r", F.row_number().over(by_item.orderBy("h")))
    # Partition p holds the items of 2**p to 2**(p+1) - 1 shingles; of s shingles a contained item lacks s - ceil(s * num / den) at most.
    most = F.pow(2.0, F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("long") - 1
    shingles = shingles.withColumn("k", most - F.ceil(most * num / den) + 1)
    sketch = shingles.where("r <= k").select("item", "m", "h")
    bounds = {r["m"]: r for r in sketch.groupBy("m").agg(F.max("h").alias("high"), F.count("*").alias("rows")).collect()}
    sketch_rows = sum(r["rows"] for r in bounds.values())
    whole = shingles.groupBy("item", "m").agg(F.collect_set("h").alias("set"))

    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), _word_hashes(F.col(text_col)).alias("wh"))
    found = []
    for m, bound in sorted(bounds.items()):
        own = hashed.where(F.size("wh") >= m).select("id", "t", "wh", F.explode(F.sequence(F.lit(0), F.size("wh") - m)).alias("at"))
        own = own.withColumn("h", _shingle(F.col("at"), m)).where(F.col("h") <= bound["high"])
        wanted = sketch.where(F.col("m") == m).select("item", "h")
        if sketch_rows <= BROADCAST_ROWS:
            pairs = own.join(F.broadcast(wanted), "h").groupBy("id", "t", "item").agg(F.first("wh").alias("wh"))
        else:
            # Hashes alone are shuffled; a document's words are fetched once it has an item to be verified.
            pairs = own.select("id", "t", "h").join(wanted, "h").select(F.col("id").alias("id2"), F.col("t").alias("t2"), "item").distinct()
            pairs = hashed.join(pairs, F.expr("id <=> id2 and t <=> t2")).select("id", "t", "item", "wh")
        pairs = pairs.join(_bounded(whole.where(F.col("m") == m).select("item", "set"), sketch_rows), "item")
        grams = F.transform(F.sequence(F.lit(0), F.size("wh") - m), lambda i: F.xxhash64(*(F.get(F.col("wh"), i + k) for k in range(m))))  # noqa: B023
        found.append(pairs.select("id", "t", "item", F.size("set").cast("long").alias("item_shingles"), F.size(F.array_intersect("set", grams)).cast("long").alias("found")))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    out = out.where(den * F.col("found") >= num * F.col("item_shingles"))
    out = out.groupBy("id", "item").agg(F.max("item_shingles").alias("item_shingles"), F.max("found").alias("found"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "item_shingles", "found", (F.col("found") / F.col("item_shingles")).alias("containment"))


#: DuckDB SQL of ``contaminated`` over documents and benchmark.
CONTAMINATED_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents where text is not null),
it as (select item_id, ws, least(5, len(ws)) as m from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark where text is not null) where len(ws) > 0),
its as (select distinct item_id, m, array_to_string(list_slice(ws, i + 1, i + m), ' ') as s from it, unnest(range(0, len(ws) - m + 1)) as g(i)),
sized as (select item_id, count(*) as n from its group by item_id),
ds as (select distinct doc_id, m, array_to_string(list_slice(ws, i + 1, i + m), ' ') as s from w, (select distinct m from it) as ms, unnest(range(0, len(ws) - m + 1)) as g(i)),
hits as (select doc_id, item_id, count(*) as found from ds join its using (m, s) group by doc_id, item_id)
select doc_id, item_id, n::bigint as item_shingles, found::bigint as found, found / n::double as containment
from hits join sized using (item_id) where 5 * found >= 4 * n"""
