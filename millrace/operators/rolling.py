"""Rolling sums, counts and means per key, over preceding rows or preceding days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import ORDER, PLACE, order_rows

BLOCK_ROWS = 1_000_000


def _with_metrics(df: DataFrame, revenue: Column, orders: Column) -> DataFrame:
    """Sum, count and their quotient, so that each row's frame is walked for two functions only."""
    summed = df.withColumns({"rolling_revenue": revenue, "rolling_order_count": orders})
    average = F.try_divide("rolling_revenue", "rolling_order_count")
    return summed.withColumn("rolling_avg_order_value", average)


def rolling_rows(
    df: DataFrame,
    key: str,
    day: str,
    amount: str,
    rows: int = 7,
    tie_break: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Metrics over the current row and the `rows - 1` before it, per `key` in `day` order.

    `tie_break` orders the rows of one day; all other columns follow, so a rerun gives the same
    frames. A key whose rows lie in several ordered partitions is framed in blocks of `block_rows` of its
    rows, each block starting with copies of the `rows - 1` rows before it; its size does not change a
    frame.
    """
    if not 1 < rows <= block_rows:
        raise ValueError("rows must be at least 2 and at most block_rows")
    ordered = order_rows(df, key, [day, *tie_break])
    feeds_next = F.col(PLACE) % block_rows > block_rows - rows
    copies = F.when(feeds_next, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    block = F.coalesce(F.floor(F.col(PLACE) / block_rows), F.lit(0)) + F.col("__copy").cast("int")
    blocks = ordered.withColumn("__copy", F.explode(copies)).withColumn("__block", block)
    frame = Window.partitionBy(key, "__block").orderBy(ORDER).rowsBetween(-(rows - 1), 0)
    framed = _with_metrics(blocks, F.sum(amount).over(frame), F.count(amount).over(frame))
    return framed.where(~F.col("__copy")).drop("__copy", "__block", PLACE, ORDER)


def rolling_days(df: DataFrame, key: str, day: str, amount: str, days: int = 7) -> DataFrame:
    """Metrics over the current calendar day and the `days - 1` before it: one row per key and day.

    Rows of one day share their frame, so the table is first summed to days (combined before the
    shuffle, busy keys included) and the window runs over at most one row per key and day.
    """
    totals = df.groupBy(key, F.col(day).cast("date").alias(day)).agg(
        F.sum(amount).alias("__sum"), F.count(amount).alias("__count")
    )
    window = (
        Window.partitionBy(key)
        .orderBy(F.unix_date(F.col(day)))
        .rangeBetween(-(days - 1), Window.currentRow)
    )
    revenue, orders = F.sum("__sum").over(window), F.sum("__count").over(window)
    return _with_metrics(totals, revenue, orders).drop("__sum", "__count")
