"""Joining and ordering a busy key's rows without putting them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sinks.scratch import scratch_path

PLACE = "__place"
ORDER = "__order"
#: `monotonically_increasing_id` holds the partition above these bits and the row within it below.
_ROW_BITS = 33


def order_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Number the rows by key and then `order`, nulls first, and place those of keys that one task can't hold.

    One path for every key, busy or not: rows are range-partitioned and sorted by the key, the order columns and
    then all others, and saved in the shared folder with a number that grows in that order (`__order`). A key that
    lies in one partition needs nothing more: a window over it is no larger than that partition, and `__place` is
    null. Only the first and last key of a partition can lie in others too. Their rows get their place within the
    key, from 0, as `__place`: the row's distance from the key's first one in the partition, and the key's rows in
    earlier partitions. At most two such keys per partition are shipped, and no row is shuffled again. Order
    columns must be sortable; of the others, those that are not (maps) are left out of the tie-break.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c != key and c not in order and "map<" not in kinds[c]]
    sorting = [F.col(c).asc_nulls_first() for c in [key, *order, *rest]]
    place = scratch_path(spark, "ordered")
    ordered = df.repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn(ORDER, F.monotonically_increasing_id())
    ordered.write.parquet(place)
    saved = spark.read.schema(ordered.schema).parquet(place)

    block = F.shiftright(ORDER, _ROW_BITS)
    keys = saved.select(F.col(key).alias("__k"), ORDER, block.alias("__b"))
    sizes = keys.groupBy("__k", "__b").agg(F.count("*").alias("__size"), F.min(ORDER).alias("__first"))
    of_key = Window.partitionBy("__k")
    earlier = F.sum("__size").over(of_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(earlier, F.lit(0)) - F.col("__first")
    found = sizes.select("__k", "__b", shift.alias("__shift"), F.count("*").over(of_key).alias("__parts"))
    placed = found.where("__parts > 1").drop("__parts")
    same = F.col(key).eqNullSafe(F.col("__k")) & (block == F.col("__b"))
    return saved.join(F.broadcast(placed), same, "left").withColumn(PLACE, F.col(ORDER) + F.col("__shift")).drop("__k", "__b", "__shift")


#: A key with more fact rows than this is spread over the tasks; at most `HOT_KEYS` keys are, the busiest.
HOT_ROWS = 5_000_000
HOT_KEYS = 100_000
SPREAD = 256


def enrich_hot(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
    spread_by: Sequence[str] = (),
    max_rows: int = HOT_ROWS,
    max_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left or inner join to a dimension with unique keys that also holds for keys with most rows.

    Spark splits a skewed join only where both sides are shuffled for it, which a dimension cleaned
    in the same plan is not. So facts of hot and of null keys are spread over `SPREAD` lots by a hash,
    and the dimension rows of hot keys are repeated for every lot. Only the list of hot keys is
    broadcast, of at most `max_keys` keys and no other column; a key beyond it is joined as any other,
    which gives the same rows. `counted` may be a cheaper table with at least the facts' rows
    per key; `spread_by` names fact columns that tell rows of one key apart (all columns
    otherwise, which a later projection then cannot drop).
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    keys = list(keys)
    values = [c for c in dimension.columns if c not in keys]
    rows_of_key = (facts if counted is None else counted).groupBy(*keys).agg(
        F.count("*").alias("__rows")
    )
    busiest = rows_of_key.where(F.col("__rows") > max_rows).orderBy(F.desc("__rows"), *keys).limit(max_keys)
    hot_keys = F.broadcast(busiest.select(*keys, F.lit(True).alias("__hot")))

    marked = facts.join(hot_keys, keys, "left")
    apart = F.col("__hot").isNotNull()
    for key in keys:
        apart = apart | F.col(key).isNull()
    part = F.pmod(F.xxhash64(*(spread_by or facts.columns)), F.lit(SPREAD)).cast("int") + 1
    marked = marked.withColumn("__spread", F.when(apart, part).otherwise(0)).drop("__hot")
    lots = F.when(F.col("__hot"), F.sequence(F.lit(1), F.lit(SPREAD))).otherwise(F.array(F.lit(0)))
    repeated = dimension.join(hot_keys, keys, "left").select(*keys, *values, F.explode(lots).alias("__spread"))

    joined = marked.join(repeated, [*keys, "__spread"], how)
    ordered = [*keys, *[c for c in facts.columns if c not in keys]]
    return joined.select(*ordered, *values)
