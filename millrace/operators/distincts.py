"""Exact distinct counts that roll up and are added to by batches: bitmaps over numbered ids.

Distinct counts can't be added, but the sets behind them can be joined. Ids get consecutive numbers once, and a
set of them is kept as bitmaps of 32,768 numbers each. A coarser count is the union of finer bitmaps, so the rows
are not read again, and a batch that is added twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sinks.scratch import scratch_path
from millrace.sinks.tables import append, overwrite

NUMBER, BUCKET, BITMAP = "number", "bucket", "bitmap"
#: `monotonically_increasing_id` counts a task's rows in its lower 33 bits.
_ROW_BITS = (1 << 33) - 1


def number_ids(spark: SparkSession, table: str, rows: DataFrame, column: str) -> None:
    """Give every value of `column` not yet in `table` (columns `column` and `number`) a number of its own.

    Numbers run from 1 without gaps, on from those given before, and stay. They are counted within each task, and the tasks'
    totals, one row a task, move them on; so no task sees all ids. Nulls get none. A rerun adds nothing.
    """
    ids = rows.select(column).where(F.col(column).isNotNull()).distinct()
    first = 1  # bitmaps of 32,768 bits begin at 1
    if spark.catalog.tableExists(table):
        known = spark.table(table)
        ids = ids.join(known.select(column), [column], "left_anti")
        last = known.agg(F.max(NUMBER)).first()[0]
        first = 1 if last is None else last + 1
    place = scratch_path(spark, "new_ids")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    marked = ids.select(column, F.spark_partition_id().alias("__task"), row.alias("__row"))
    marked.write.parquet(place)
    saved = spark.read.schema(marked.schema).parquet(place)
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    totals = saved.groupBy("__task").agg(F.count("*").alias("__rows"))
    offsets = totals.select("__task", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    number = (F.lit(first) + F.col("__before") + F.col("__row")).cast("bigint")
    append(saved.join(offsets, ["__task"]).select(column, number.alias(NUMBER)), table)


def distinct_states(rows: DataFrame, numbers: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The set of `column` values per key as bitmaps: keys, `bucket`, `bitmap`; every value must be numbered.

    Pairs are made distinct before the join, each task its own first, so a value that most rows hold is one pair
    per key. A key without values has no bitmap.
    """
    pairs = rows.select(*keys, column).where(F.col(column).isNotNull()).distinct()
    numbered = pairs.join(numbers.select(column, NUMBER), [column], "left")
    unknown = F.raise_error(F.concat(F.lit(f"no number for {column} "), F.col(column).cast("string"))).cast("bigint")
    numbered = numbered.withColumn(NUMBER, F.coalesce(NUMBER, unknown))
    grouped = numbered.groupBy(*keys, F.bitmap_bucket_number(NUMBER).alias(BUCKET))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias(BITMAP))


def roll_up(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sets of fewer keys, or of several batches, as the union of those kept."""
    return states.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def distinct_counts(states: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many values each key has; without keys, one row."""
    counted = roll_up(states, keys).groupBy(*keys).agg(F.sum(F.bitmap_count(BITMAP)).alias(name))
    return counted.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))


def distinct_levels(states: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Counts by all keys, by all but the last, and so on to the total; keys that a level has not are null there.

    `level` is the number of keys a row is counted by, which tells a total from a null key.
    """
    kinds = dict(states.dtypes)
    levels = []
    for n in range(len(keys), -1, -1):
        left_out = [F.lit(None).cast(kinds[k]).alias(k) for k in keys[n:]]
        found = distinct_counts(states, keys[:n], name)
        levels.append(found.select(F.lit(n).alias("level"), *keys[:n], *left_out, name))
    return reduce(DataFrame.unionByName, levels)


def add_distincts(spark: SparkSession, states: str, numbers: str, batch: DataFrame, keys: Sequence[str], column: str) -> None:
    """Add a batch to the kept sets; only the batch and the numbers are read. A rerun changes no count.

    Its bitmaps are appended, and united when they are read. `compact_distincts` keeps the table small.
    """
    number_ids(spark, numbers, batch, column)
    append(distinct_states(batch, spark.table(numbers), keys, column), states)


def compact_distincts(spark: SparkSession, states: str, keys: Sequence[str]) -> None:
    """Replace the bitmaps of all batches by their unions."""
    overwrite(roll_up(spark.table(states), keys), states)
