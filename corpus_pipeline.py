"""A training-data pipeline in five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and gives the documents that stay, with
the columns of documents; the last gives packed pieces. ``run`` writes what a
stage gives as Parquet into the shared folder and hands the reread table on.
All columns come back from each but the last, whatever else they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.decontaminate import contaminated
from pathloom.llm.jaccard_join import jaccard_classes
from pathloom.llm.packing import pack
from pathloom.llm.storage import named_again, numbered_columns, saved, ship_library, table
from pathloom.llm.substring_dedup import remove_repeats
from pathloom.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.7 or more. The model learns from the labels of this stage's documents.

    Rows are judged alone, so ids may be null or repeat; null and empty texts
    stay, as all do where labels of one kind are missing. An empty table gives none.
    """
    ship_library(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where("crc32(cast(doc_id as string)) % 3 <> 1"))
    rows, names = numbered_columns(docs)
    return named_again(score_toxicity(rows, model, names["text"]).where("score < 0.7"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word shingle Jaccard of 0.8 or more, one of each group stays: that with the smallest id.

    Ids may be null or repeat: a row is judged by its text, rows with an id go
    before those without, and of rows of one id and text one stays. Texts
    without words are linked with nothing, so all of them stay, repeats too.
    """
    ship_library(spark)
    rows = jaccard_classes(docs, width=5, num=80, den=100).select("n", "comp", F.struct(F.col("id").isNull().alias("none"), "id", "text_hash").alias("row"))
    first = rows.where("n > 0").groupBy("comp").agg(F.min("row").alias("row"))
    stay = first.union(rows.where("n = 0").select(F.lit(None).cast("long").alias("comp"), "row").distinct())
    stay = stay.select(F.xxhash64("row.id", "row.text_hash").alias("_key"), F.col("comp").isNull().alias("_all"))
    docs, names = numbered_columns(docs)
    keyed = docs.withColumn("_key", F.xxhash64(names["doc_id"], F.xxhash64(F.col(names["text"]).cast("string"))))
    keyed = keyed.join(stay, "_key")
    once = keyed.where("not _all").dropDuplicates(["_key"])
    return named_again(once.unionByName(keyed.where("_all")), names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that recur in any document; texts that lose nothing stay as they are.

    No row goes: null texts stay null, one that is cut whole becomes empty.
    Repeated rows are copies of each other, so they are cut; ids are not used.
    """
    ship_library(spark)
    docs, names = numbered_columns(docs)
    text, size = names["text"], names["n_chars"]
    out = remove_repeats(docs.withColumn("_text", F.col(text)), text)
    cut = F.col("n_removed") > 0
    out = out.withColumn(text, F.when(cut, F.col("kept")).otherwise(F.col("_text"))).withColumn(size, F.when(cut, F.length("kept").cast("long")).otherwise(F.col(size)))
    return named_again(out, names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item: 0.8 or more of its 5-word shingles.

    Rows are judged by id and text, so ids may be null or repeat; repeated rows
    go or stay together. Null and empty texts stay, as all do without items.
    """
    rows, names = numbered_columns(docs)
    doc, text = names["doc_id"], names["text"]
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("_key"), "text")
    hit = contaminated(keyed, table(spark, sf_dir, "benchmark"), "_key").select(F.col("_key.id").alias("_id"), F.col("_key.t").alias("_t")).distinct()
    return named_again(rows.join(hit, F.col(doc).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_t")), "left_anti"), names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what stays into sequences of 2048 tokens; one row per piece. Null and empty texts are the end id alone; each row is packed, whatever its id."""
    import public_tokenizers

    ship_library(spark)
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A model, a graph search and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None
