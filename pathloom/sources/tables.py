"""Written tables in the folder that driver and executors share, numbering, and the spread of small tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a new local folder, but only if all of Spark is one process: others would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_within = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Discards at its end the tables that this thread has kept within it: for steps that write all their results themselves."""
    outer, _within.tables = getattr(_within, "tables", None), []
    try:
        yield
    finally:
        own, _within.tables = _within.tables, outer
        discard(*own)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet and read back: computed once, with a short plan, whatever reads it.

    It stays in the shared folder until ``discard`` takes it away, or the
    folder's owner does: what is built on it may be run at any later time.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if (own := getattr(_within, "tables", None)) is not None:
        own.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` gave, once nothing that reads them will run again."""
    for table in tables:
        if path := _paths.pop(table, None):
            jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Rows of a scan that one task gets at most: a URL of a few bytes in a dense file is a thousand bytes of parts.
ROWS = 200_000


def spread(df: DataFrame) -> DataFrame:
    """A scan is dealt out to all cores, and to as many tasks as give none more than about ``ROWS`` rows; one with as many splits stays as it is.

    ``df`` must be a scan with projections alone, whose splits are known without
    running anything, and whose rows the files' footers give.
    """
    splits = df.rdd.getNumPartitions()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(tasks) if splits < tasks else df


_INDEX = (1 << 33) - 1  # the part of a monotonically increasing id that counts within its partition


def numbered(df: DataFrame, out: str, first: int = 1, by: list | None = None) -> DataFrame:
    """``df`` plus ``out``: numbers without gaps from ``first`` on, in the order of its parts and of the rows in each.

    ``by`` are the columns that name and order the parts (files and their
    splits); without it they are the partitions as they come. A part's rows must
    lie in one partition in their order. Parts are counted first, so ``df`` is
    evaluated twice and must split alike both times, as a scan does; ``ranked``
    is for others. Only the counts, one row a part, meet in one task.
    """
    own = by or [F.spark_partition_id()]
    names = [f"_part{k}" for k in range(len(own))]
    df = df.select("*", *(c.alias(n) for c, n in zip(own, names, strict=True)), F.monotonically_increasing_id().bitwiseAND(_INDEX).alias("_index"))
    parts = df.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_index").alias("_low"))
    before = F.sum("_n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*names, (F.coalesce(before, F.lit(0)) + first - F.col("_low")).alias("_from"))
    return df.join(parts, names).withColumn(out, F.col("_from") + F.col("_index")).drop(*names, "_index", "_from")


def ranked(df: DataFrame, out: str, *order: str, first: int = 1) -> tuple[DataFrame, int, DataFrame]:
    """(``df`` plus ``out``: numbers without gaps from ``first`` on in that order; how many rows; the kept table below).

    Rows are sorted over all tasks and kept once with their places, so that the
    numbers are the same whenever they are read. ``discard`` the last when done.
    """
    place = F.monotonically_increasing_id()
    held = kept(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), place.bitwiseAND(_INDEX).alias("_index")), "ranked")
    # One row a partition of the sort: the size of the cluster, not of the table.
    sizes = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total + first))
        total += n
    if not total:
        return held.withColumn(out, F.col("_index")).drop("_part", "_index"), 0, held
    start = df.sparkSession.createDataFrame(before, "_part int, _from long")
    return held.join(F.broadcast(start), "_part").withColumn(out, F.col("_from") + F.col("_index")).drop("_part", "_index", "_from"), total, held
