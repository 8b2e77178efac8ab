"""Writing a table beside another and putting it in its place, so that no failure loses the old rows.

The new rows go to `<table>__next_<run>`. Once they are complete, that table is marked ready, and only then is
the old one touched. A run that stops after the mark is finished by `recover`, which repeats the last step;
a run that stops before it has changed nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

READY = "millrace.ready"
REPLACE, PARTITIONS, FILES = "replace", "partitions", "files"
KINDS = ("next", "batch", "gone")

#: Looks at rows that are complete but not yet in their table, and raises to keep them out of it.
Audit = Callable[[DataFrame], None]


class Buckets(NamedTuple):
    """Rows dealt into `number` files by a hash of `keys`, each file sorted by them."""

    keys: list[str]
    number: int


class TableBusy(RuntimeError):
    """Another run writes the table, or one that stopped left its unfinished copy."""


def new_run() -> str:
    return uuid.uuid4().hex[:12]


def _copies(spark: SparkSession, table: str, kind: str) -> list[str]:
    """Tables of that kind beside `table`, by full name; a view of such a name is none."""
    database, _, name = table.rpartition(".")
    prefix = f"{name}__{kind}_".lower()
    within = f"IN {database} " if database else ""
    found = spark.sql(f"SHOW TABLES {within}LIKE '{prefix}*'").where("NOT isTemporary").collect()
    names = [r["tableName"] for r in found if r["tableName"].startswith(prefix) and len(r["tableName"]) == len(prefix) + 12]
    return [f"{database}.{n}" if database else n for n in names]


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    comment = spark.catalog.getTable(table).description
    return {**found, "comment": comment} if comment else found


def partitioning(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def bucketing(spark: SparkSession, table: str) -> Buckets | None:
    """How the rows of a stored table are dealt by key, if they are."""
    keys = [c.name for c in spark.catalog.listColumns(table) if c.isBucket]
    if not keys:
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return Buckets(keys, int(described["data_type"]))


def refuse_if_busy(spark: SparkSession, table: str) -> None:
    """Finish what a stopped run decided; refuse when unfinished copies remain (see `abandon`)."""
    recover(spark, table)
    left = [name for kind in KINDS for name in _copies(spark, table, kind)]
    if left:
        raise TableBusy(f"{table} is being written, or a stopped run left {left}; abandon() drops them")


def abandon(spark: SparkSession, table: str) -> None:
    """Drop the unfinished copies of runs that are known to have stopped; finished ones are applied."""
    recover(spark, table)
    for name in [name for kind in KINDS for name in _copies(spark, table, kind)]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def write(df: DataFrame, table: str, partition_by: Sequence[str] = (), buckets: Buckets | None = None) -> None:
    if buckets is not None:
        # Dealt as the files are, so that a bucket is one file.
        dealt = df.repartition(buckets.number, *buckets.keys).write.mode("overwrite")
        dealt.bucketBy(buckets.number, *buckets.keys).sortBy(*buckets.keys).saveAsTable(table)
        return
    # One task per partition value would follow the data's skew: let Spark balance the files.
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def commit(spark: SparkSession, table: str, following: str, how: str) -> None:
    """Mark the finished copy ready and put it in place."""
    spark.sql(f"ALTER TABLE {following} SET TBLPROPERTIES ('{READY}' = '{how}')")
    _apply(spark, table, following, how)


def location(spark: SparkSession, table: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return described.where("col_name = 'Location'").first()["data_type"]


def gone_beside(following: str) -> str:
    """The table of the files that the rows of `following` replace."""
    head, _, run = following.rpartition("__next_")
    return f"{head}__gone_{run}"


def _exchange_files(spark: SparkSession, table: str, following: str) -> None:
    """Move the files of `following` into the table's folders, then delete those they replace.

    Each step may be repeated: a file that is no longer there was moved or deleted by the run before.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = (hadoop.Path(location(spark, name)) for name in (following, table))
    folders = source.getFileSystem(conf)
    listing, written = folders.listFiles(source, True), []
    while listing.hasNext():
        written.append(listing.next().getPath())
    for path in written:
        if path.getName().startswith(("_", ".")):
            continue
        place = hadoop.Path(target, folders.makeQualified(source).toUri().relativize(path.toUri()).getPath())
        folders.mkdirs(place.getParent())
        if not folders.rename(path, place):
            raise RuntimeError(f"{path} can't be moved to {place}")
    gone = gone_beside(following)
    if spark.catalog.tableExists(gone):
        for row in spark.table(gone).toLocalIterator():
            folders.delete(hadoop.Path(spark._jvm.java.net.URI(row["path"])), False)
    if partitioning(spark, table):
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    spark.catalog.refreshTable(table)
    spark.sql(f"DROP TABLE IF EXISTS {gone}")
    spark.sql(f"DROP TABLE {following}")


def _apply(spark: SparkSession, table: str, following: str, how: str) -> None:
    if how == FILES:
        _exchange_files(spark, table, following)
        return
    if how == PARTITIONS:
        # insertInto takes this setting from the session only, so it gets a session of its own.
        own = spark.newSession()
        own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        columns = spark.table(table).columns
        own.table(following).select(*columns).write.mode("overwrite").insertInto(table)
        spark.catalog.refreshTable(table)
        spark.sql(f"DROP TABLE {following}")
        return
    parts = partitioning(spark, following)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    if parts:  # folders of partitions keep the name they were written under
        kept = {k: v for k, v in properties(spark, following).items() if k != READY}
        write(spark.table(following), table, parts)
        keep_properties(spark, table, kept)
        spark.sql(f"DROP TABLE {following}")
    else:
        spark.sql(f"ALTER TABLE {following} UNSET TBLPROPERTIES ('{READY}')")
        spark.sql(f"ALTER TABLE {following} RENAME TO {table}")


def recover(spark: SparkSession, table: str) -> None:
    """Apply copies that a stopped run had marked ready, or whose mark it had just taken off."""
    for following in _copies(spark, table, "next"):
        how = properties(spark, following).get(READY)
        if how is not None:
            _apply(spark, table, following, how)
        elif not spark.catalog.tableExists(table) and properties(spark, following).get(f"{READY}.from"):
            spark.sql(f"ALTER TABLE {following} RENAME TO {table}")


def keep_properties(spark: SparkSession, table: str, values: dict[str, str]) -> None:
    own = {k: v for k, v in values.items() if k != READY and not k.startswith(("option.", "spark.sql."))}
    pairs = ", ".join("'{}' = '{}'".format(k.replace("'", "\\'"), v.replace("'", "\\'")) for k, v in own.items())
    if pairs:
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def replace(
    df: DataFrame,
    table: str,
    partition_by: Sequence[str] = (),
    keep: bool = False,
    audit: Audit | None = None,
    buckets: Buckets | None = None,
) -> None:
    """Put the rows of `df`, which may read the table itself, in the table's place.

    They are written beside it and shown to `audit` there; a failing write or audit leaves the table as it was. With
    `keep`, the old table's properties (its comment among them) go to the new one.
    """
    spark = df.sparkSession
    refuse_if_busy(spark, table)
    following = f"{table}__next_{new_run()}"
    try:
        write(df, following, partition_by, buckets)
        if audit is not None:
            audit(spark.table(following))
        finish(spark, table, following, keep)
    except Exception:
        _drop_unless_ready(spark, following)
        raise


def replace_partition(df: DataFrame, table: str, column: str, value: str, audit: Audit | None = None) -> None:
    """Put the rows of `df`, all of one partition, in that partition's place; no rows remove it."""
    spark = df.sparkSession
    refuse_if_busy(spark, table)
    following = f"{table}__next_{new_run()}"
    try:
        write(df.select(*spark.table(table).columns), following, [column])
        rows = spark.table(following)
        if audit is not None:
            audit(rows)
        if rows.isEmpty():
            quoted = value.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (`{column}` = '{quoted}')")
            spark.sql(f"DROP TABLE {following}")
        else:
            commit(spark, table, following, PARTITIONS)
    except Exception:
        _drop_unless_ready(spark, following)
        raise


def finish(spark: SparkSession, table: str, following: str, keep: bool) -> None:
    values = properties(spark, table) if keep and spark.catalog.tableExists(table) else {}
    keep_properties(spark, following, {**values, f"{READY}.from": "complete"})
    commit(spark, table, following, REPLACE)
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{READY}.from')")


def _drop_unless_ready(spark: SparkSession, following: str) -> bool:
    """Drop a copy that is not marked ready; tells whether none is left."""
    if spark.catalog.tableExists(following):
        if READY in properties(spark, following):
            return False
        spark.sql(f"DROP TABLE {following}")
    return True
