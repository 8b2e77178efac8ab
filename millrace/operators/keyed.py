"""One row per key, and netting of repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PICK = "__pick"


def first_per_key(
    df: DataFrame,
    keys: Sequence[Column | str],
    order: Sequence[Column | str] = (),
) -> DataFrame:
    """The first row of every key by `order`, ties broken by the remaining columns.

    The tie-break makes a rerun pick the same row. Spark plans the `= 1` filter as a group limit
    before the shuffle, so each input task ships one row per key however many copies a key has.
    """
    placed = {c for c in (*keys, *order) if isinstance(c, str)}
    tie_break = [F.col(c) for c in df.columns if c not in placed]
    window = Window.partitionBy(*keys).orderBy(*order, *tie_break)
    ranked = df.withColumn(_PICK, F.row_number().over(window))
    return ranked.where(F.col(_PICK) == 1).drop(_PICK)


def first_per_trimmed_key(df: DataFrame, key: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """The first row of every key, blanks around it ignored; the key comes out trimmed.

    The table stays partitioned by the trimmed key, so a join on it needs no second shuffle.
    """
    return first_per_key(df.withColumn(key, F.trim(key)), [key], order)


def latest_per_key(df: DataFrame, keys: Sequence[Column | str], sequence: str) -> DataFrame:
    """The row with the highest `sequence` of every key."""
    return first_per_key(df, keys, [F.col(sequence).desc_nulls_last()])


def net_changes(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """One row per key holding the sum of its changes."""
    return df.groupBy(*keys).agg(F.sum(amount).alias(amount))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur on more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
