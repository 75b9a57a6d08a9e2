"""Live feeds: lines of text in, normal forms out, each as the corpus stood when its URL had arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.extract import extract_urls
from ..sources.store import Corpus
from ..sources.tables import scratch


def batch_log(lines: DataFrame, *, scheme_less: bool = True) -> DataFrame:
    """The log of a micro-batch: its URLs in the order of lines and places."""
    found = extract_urls(lines.select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("text")), scheme_less=scheme_less)
    return found.select(F.struct("line_id", "pos").alias("obs_id"), F.col("iri.canonical").alias("url"))


def normalize_stream(lines: DataFrame, corpus: Corpus, out: str, checkpoint: str, *, hints: bool = True, **trigger) -> StreamingQuery:
    """Starts a query from a stream of ``value`` lines to Parquet (obs_id, normalized) under ``out``.

    Each micro-batch is committed to the corpus, which numbers its URLs, and
    rendered with evidence carried on from the state after the batch before;
    activations are read again each time. The checkpoint names the writer: a
    batch that is retried finds its commit and renders it again, so each line
    counts once, and any number of streams and other writers may share a corpus.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch():
            commit = corpus.append(batch_log(batch), batch_id, writer=f"stream {checkpoint}")
            corpus.normalized_at(commit, hints=hints).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
