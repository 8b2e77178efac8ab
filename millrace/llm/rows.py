"""Filtering whole rows by doc_id, whatever else the rows hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(columns: Iterable[str], name: str) -> str:
    """`name`, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id is not in `ids`; rows without doc_id stay."""
    key = fresh(docs.columns, "dropped_id")
    dropped = ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(key)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped[key], "left_anti")
