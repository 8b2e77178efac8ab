"""Joins that name their keys and state their row-count behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on named columns. A join without keys would multiply the tables, so it is refused."""
    if isinstance(keys, str) or not keys:
        raise ValueError("a join needs a non-empty list of key columns")
    if how == "cross":
        raise ValueError("a cross join has no keys")
    for side, columns in (("left", left.columns), ("right", right.columns)):
        missing = [k for k in keys if k not in columns]
        if missing:
            raise ValueError(f"{side} side lacks key column(s) {missing}; it has {columns}")
    return left.join(right, list(keys), how)


def enrich(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join: every fact row stays. No hint: Spark broadcasts a side its size statistics allow,
    and splits skewed partitions of the facts otherwise."""
    return keyed_join(facts, dimension, keys, "left")


def match(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join: fact rows without a dimension row drop out."""
    return keyed_join(facts, dimension, keys, "inner")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose key has no parent row. Only the key columns of the parent are read."""
    return keyed_join(child, parent.select(*keys), keys, "left_anti")


def _row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's size: text by its bytes, other columns by a fixed width."""
    sizes = []
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 16)
        elif kind.startswith(("array", "map", "struct")):
            sizes.append(F.octet_length(F.to_json(F.struct(name))) + 16)
        else:
            sizes.append(F.lit(16))
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return total.cast("bigint")


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a table against both limits (an action). At most `max_rows` + 1 rows are counted, of which
    only the sizes are gathered."""
    measured = (
        df.select(_row_bytes(df).alias("b"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
        .first()
    )
    return measured["rows"] <= max_rows and measured["bytes"] <= max_bytes


def enrich_small(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join that ships the dimension to every task when its measured size allows, else an ordinary
    join without a hint. Both give the same rows."""
    if fits_broadcast(dimension, max_rows, max_bytes):
        dimension = F.broadcast(dimension)
    return keyed_join(facts, dimension, keys, how)


def interaction_scores(
    interactions: DataFrame,
    customers: DataFrame,
    touchpoints: DataFrame,
    customer: str,
    touchpoint: str,
) -> DataFrame:
    """Score every real (customer, touchpoint) pair of the full customer x touchpoint matrix.

    The matrix is only ever wanted where an interaction exists, so the pairs come from the
    interactions and the product is never formed. The score is a hash of both ids in [0, 1): a
    rerun gives the same value.
    """
    pairs = interactions.select(customer, touchpoint).distinct()
    known = keyed_join(pairs, customers.select(customer), [customer], "left_semi")
    known = keyed_join(known, touchpoints.select(touchpoint), [touchpoint], "left_semi")
    digest = F.md5(F.concat_ws(":", F.col(customer), F.col(touchpoint)).cast("binary"))
    score = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
    return known.select(customer, touchpoint, score.alias("score"))
