"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster, clusters_sql
from .decontaminate import CONTAMINATED_SQL, contaminated
from .hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from .html_extract import extract_text, fit_extraction
from .jaccard_join import jaccard_components
from .licenses import scan_licenses, scan_licenses_sql
from .packing import pack
from .quality import fit_quality, grade_quality
from .repetition import repetition_rules
from .sharding import assign_shards, sharding_sql
from .storage import ship_library, table
from .substring_dedup import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def _query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_library(spark)
        return f(spark, sf_dir)

    return run


#: Of a document's id as text; rows where it is 1 are held out of all fits.
_REMAINDER = "crc32(cast(doc_id as string)) % 3"


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: 0 low quality, 1 fluent but toxic, 2 fluent and clean. Kept: P(rating > 0) >= 0.5."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(f"{_REMAINDER} <> 1")
    rating = F.expr("case when quality = 1 then 2 - toxic when quality = 0 then 0 end")
    out = grade_quality(docs.select("doc_id", "text"), fit_quality(docs, labels, rating))
    tail = F.try_element_at("tails", F.lit(1))
    return out.select("doc_id", F.expr(f"coalesce({_REMAINDER} = 1, false)").alias("held_out"), "expected_grade", tail.alias("p_fluent"), F.try_element_at("tails", F.lit(2)).alias("p_clean"), F.coalesce(tail >= 0.5, F.lit(True)).alias("kept"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored for toxicity by a model of the labels that are not held out. Null and empty texts score 0; a null id is not held out; repeated rows score alike."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(f"{_REMAINDER} <> 1"))
    out = score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.expr(f"coalesce({_REMAINDER} = 1, false)").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), F.transform("offending", lambda x: x["sentence"]).alias("offending"))


@_query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the set and component of every row, by 3-word shingles at 0.9. Nulls, empty texts and repeats: as ``jaccard_components`` says."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


@_query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 2,048 tokens. Null and empty texts are the end id alone; repeated rows and null ids are packed as rows of their own."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without recurring runs of 35 words. Null and empty texts lose nothing; repeated rows are copies of each other."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition of every text and the verdict on it. Null and empty texts fail; repeated rows get equal results."""
    return repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


#: Rules of op9: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@_query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL. Null URLs and those without ``://`` have an empty host and path; ids may be null or repeated."""
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


#: Shards of op10.
SHARDS = [f"shard-{k:02d}" for k in range(64)]


@_query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every id. Equal ids share a shard, null ones too."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


@_query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item. Null and empty texts contain none; repeated rows give one result; a null id is a value like others."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state. Null and empty texts give no row; repeated rows give one; a null id is a value like others."""
    return scan_licenses(table(spark, sf_dir, "documents"))


@_query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty pages have an empty text; ids and URLs may be null or repeated."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, fit_extraction(pages)).select("page_id", "url", "text", "n_chars")


@_query
def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50, among all rows. Rows with nulls or components that are not finite take no part."""
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@_query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 finite components; others give no row. Null ids stay, repeated ones are vectors of their own."""
    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_quality_classifier,
        op2_benchmark_decontamination,
        op3_toxicity,
        op4_license_scans,
        op5_ngram_jaccard_join,
        op6_packing,
        op7_substring_dedup,
        op8_quality_rules,
        op9_url_filters,
        op10_sharding,
        op11_html_extraction,
        op12_hard_negative_mining,
        op13_centroid_clustering,
    )
}
SQL: dict[str, str] = {
    "op2_benchmark_decontamination": CONTAMINATED_SQL,
    "op4_license_scans": scan_licenses_sql(),
    "op10_sharding": sharding_sql(SHARDS, "doc_id", "documents"),
    "op12_hard_negative_mining": HARD_NEGATIVES_SQL,
    "op13_centroid_clustering": clusters_sql(),
}
