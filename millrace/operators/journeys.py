"""Ordered event lists per key that no busy key can blow up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import ORDER, PLACE, order_rows


def event_journeys(
    events: DataFrame,
    key: str,
    sequence: str,
    payload: str,
    max_events: int = 10_000,
    tie_break: str | None = None,
) -> DataFrame:
    """Every key's events in `sequence` order, as parts of at most `max_events` events.

    A placeholder key can hold most of the rows, so one list per key would have to fit one task and
    one row. Events are ordered by key and cut into parts; a key's parts read in `part_no` order
    are its whole journey, nothing dropped. Keys that several tasks hold are cut before the shuffle, the others
    after it. Events of one place in the sequence are ordered by `tie_break`, then by payload.
    """
    order = list(dict.fromkeys([sequence, *([tie_break] if tie_break else []), payload]))
    ordered = order_rows(events.select(key, *order), key, order)
    cut = ordered.withColumn("__cut", F.coalesce(F.floor(F.col(PLACE) / max_events), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(key, "__cut").orderBy(ORDER)) - 1
    parts = (
        cut.withColumn("part_no", F.col("__cut") + F.floor(within / max_events))
        .groupBy(key, "__cut", "part_no")
        .agg(
            F.count("*").alias("event_count"),
            F.min(sequence).alias("first_" + sequence),
            F.max(sequence).alias("last_" + sequence),
            F.collect_list(F.struct(ORDER, F.col(payload).alias("payload"))).alias("__list"),
        )
    )
    lists = F.transform(F.array_sort("__list"), lambda e: e["payload"])
    return parts.withColumn("events", lists).drop("__list", "__cut")
