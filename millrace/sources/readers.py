"""Readers that fail early and clearly, before any join is planned on top of them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FeedMissing(FileNotFoundError):
    """A feed a job was told to read is not there."""


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a parquet feed; a missing or empty location is reported as such."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FeedMissing(f"no parquet feed at {path}; check where it is delivered") from error
        raise


def scan_text_feed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Read a headed CSV feed with every column as text; an empty field is a blank, never null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        feed = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .csv(path)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FeedMissing(f"no text feed at {path}; check where it is delivered") from error
        raise
    return feed.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def typed_rows(spark: SparkSession, rows: Sequence[tuple[Any, ...]], schema: str | T.StructType) -> DataFrame:
    """A small reference table from inline rows; the schema is never inferred from them."""
    return spark.createDataFrame(list(rows), schema)


def day_slice(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows of one day; prunes to one folder where the table is partitioned by the column."""
    return df.where(F.col(column) == F.lit(day))
