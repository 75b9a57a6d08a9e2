"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import kept


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors."""
    return kept(df, name)


def others_of(docs: DataFrame, *made: str) -> list[str]:
    """Columns that pass through beside new ones: a column named like a new one, whatever its case, is replaced by it."""
    new = {m.lower() for m in made}
    return [c for c in docs.columns if c.lower() not in new]


def named(column: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col(f"`{column.replace('`', '``')}`")


def row_of(columns: list[str]) -> Column:
    """These columns as one struct; without any, a struct that holds nothing of the row."""
    return (F.struct(*map(named, columns)) if columns else F.struct(F.lit(0).alias("_"))).alias("row")


def fields_of(columns: list[str]) -> list[Column]:
    """The columns that ``row_of`` has put together, each under its name."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def numbered_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator makes, and by each column's name that one: for steps that give all columns back."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named_again(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``numbered_columns`` under their own names."""
    return docs.select(*(F.col(c).alias(name) for name, c in names.items()))


def row_and(rows: DataFrame, ddl: str) -> StructType:
    """The schema of a table that carries the struct ``row`` of ``rows`` beside new columns."""
    return StructType([rows.schema["row"], *StructType.fromDDL(ddl)])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more: its cleaner waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_library(spark: SparkSession) -> None:
    """Lets Python workers import this package even when the driver found it through ``sys.path`` alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
