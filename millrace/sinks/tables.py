"""Table writes with the guarantees a job relies on.

Tables take the session's default format (`spark.sql.sources.default`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.checks.gates import EXAMPLES, GateFailed
from millrace.sinks import staged
from millrace.sinks.staged import Audit, Buckets


class SchemaChanged(ValueError):
    """A write would have changed the columns of its target."""


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(name, kind) for name, kind in df.dtypes]


def table_columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return columns_of(spark.table(table))


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str]):
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    return writer.partitionBy(*partition_by) if partition_by else writer


def overwrite(df: DataFrame, table: str, partition_by: Sequence[str] = (), audit: Audit | None = None) -> None:
    """Replace the data and, where the columns differ, the schema. A rerun gives the same table.

    The rows are complete beside the old table, and `audit` has passed them there, before that is touched: a
    failing write or audit leaves it. `df` may read the table itself.
    """
    staged.replace(df, table, partition_by, audit=audit)


def overwrite_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, audit: Audit | None = None) -> None:
    """Replace the table as `overwrite` does, dealt into `buckets` files by a hash of `keys`, each sorted by them.

    Joins and groupings on these keys then read the files where they lie: tables of the same number of buckets (or a
    multiple) and key types are joined without a shuffle, as often as they are joined. Choose `buckets` so that a file
    is some hundred MB. All rows of a key lie in one file, nulls too, so this is for keys of which none has many rows (an
    order, an invoice); join busy keys by `enrich_hot`.
    """
    staged.replace(df, table, audit=audit, buckets=Buckets(list(keys), buckets))


def overwrite_same_schema(df: DataFrame, table: str, partition_by: Sequence[str] = (), audit: Audit | None = None) -> None:
    """Replace the data of a published table as `overwrite` does; refuse, before writing, to change its columns."""
    spark = df.sparkSession
    staged.recover(spark, table)
    if spark.catalog.tableExists(table):
        published, offered = table_columns(spark, table), columns_of(df)
        if published != offered:
            raise SchemaChanged(f"{table} has columns {published}, the write has {offered}")
    staged.replace(df, table, partition_by, keep=True, audit=audit)


def replace_slice(df: DataFrame, table: str, column: str, value: str, audit: Audit | None = None) -> None:
    """Put `df` in the place of one slice of a table, say a day or a run; a rerun of it gives the same table.

    The table is partitioned by `column`, which the rows get with this value, and created by its first slice. Files of other
    slices are not touched, and a slice without rows is removed. A failing write or audit leaves the old slice.
    """
    spark = df.sparkSession
    rows = df.withColumn(column, F.lit(value))
    staged.recover(spark, table)
    if not spark.catalog.tableExists(table):
        staged.replace(rows, table, [column], audit=audit)
        return
    published, offered = table_columns(spark, table), columns_of(rows)
    if sorted(published) != sorted(offered) or staged.partitioning(spark, table) != [column]:
        raise SchemaChanged(f"{table} has columns {published}, partitioned by {staged.partitioning(spark, table)}; the slice of {column} has {offered}")
    staged.replace_partition(rows, table, column, value, audit)


def append(df: DataFrame, table: str) -> None:
    """Add rows to a history table, creating it on the first run; columns must match by name."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        published = table_columns(spark, table)
        if sorted(published) != sorted(columns_of(df)):
            raise SchemaChanged(f"{table} has columns {published}, the append has {columns_of(df)}")
        df.select(*[name for name, _ in published]).write.mode("append").saveAsTable(table)
    else:
        _writer(df, "append", ()).saveAsTable(table)


def recreate(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Write the table anew, with nothing kept of the old one. `df` may read the table itself.

    The new rows are complete beside the old table before that is dropped; a failing write leaves it.
    """
    staged.replace(df, table, partition_by)


def write_checked(df: DataFrame, table: str, rule: str, partition_by: Sequence[str] = ()) -> None:
    """Write only if every row meets the SQL `rule`; a rule that is null counts as broken.

    The input is computed once: its rows are written beside the table and broken ones counted by that
    write. A failing batch leaves the table as it was.
    """
    broken = ~F.coalesce(F.expr(rule), F.lit(False))
    seen = Observation()

    def unbroken(rows: DataFrame) -> None:
        count = seen.get["broken"]
        if count:
            shown = "; ".join(str(r.asDict()) for r in rows.where(broken).take(EXAMPLES))
            raise GateFailed(f"{count} row(s) break the rule {rule!r}, e.g. {shown}")

    observed = df.observe(seen, F.count(F.when(broken, 1)).alias("broken"))
    staged.replace(observed, table, partition_by, audit=unbroken)


def _counted(raw: DataFrame, table: str, source_object: str) -> tuple[DataFrame, Observation, Audit]:
    """The rows with their source, counted as they are written, and an audit that none is lost."""
    seen = Observation()
    landed = raw.withColumn("source_object", F.lit(source_object)).observe(seen, F.count(F.lit(1)).alias("rows"))

    def complete(rows: DataFrame) -> None:
        written = rows.count()
        if written != seen.get["rows"]:
            raise GateFailed(f"{table} would have {written} rows, its source has {seen.get['rows']}")

    return landed, seen, complete


def land(raw: DataFrame, table: str, source_object: str) -> int:
    """Copy a raw table unchanged with a column naming its source; returns the row count.

    The rows are counted by the write itself and compared with those written, before the old table is touched.
    """
    landed, seen, complete = _counted(raw, table, source_object)
    overwrite(landed, table, audit=complete)
    return seen.get["rows"]


def land_slice(raw: DataFrame, table: str, source_object: str, column: str, value: str) -> int:
    """Land one delivery, say of a day, in the place of that delivery alone; returns its row count."""
    landed, seen, complete = _counted(raw, table, source_object)
    replace_slice(landed, table, column, value, audit=complete)
    return seen.get["rows"]
