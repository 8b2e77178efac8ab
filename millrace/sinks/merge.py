"""Merging a batch of changes into a plain parquet table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.maintained import Maintained
from millrace.sinks import staged
from millrace.sinks.tables import SchemaChanged, _writer


#: Beyond so many names of partitions or files, they are not listed on the driver.
MOST_NAMES = 10_000


class AmbiguousMerge(ValueError):
    """Several source rows match one target row."""


def _refuse_ambiguous(target: DataFrame, source: DataFrame, keys: Sequence[str], null_keys: bool) -> None:
    """The batch is looked at first; the target is read only if keys are repeated in it."""
    repeated = source.groupBy(*keys).count().where("count > 1").drop("count")
    if repeated.isEmpty():
        return
    sample = [tuple(r) for r in _semi(repeated, target, keys, null_keys).take(5)]
    if sample:
        raise AmbiguousMerge(f"several source rows match one target row, e.g. {keys} = {sample}")


def _semi(rows: DataFrame, held: DataFrame, keys: Sequence[str], null_keys: bool) -> DataFrame:
    """The rows whose key `held` has."""
    wanted = held.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    same = [_same(F.col(k), F.col(f"__key{i}"), null_keys) for i, k in enumerate(keys)]
    return rows.join(wanted, same, "left_semi")


_WIDER = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType),
    T.ShortType: (T.IntegerType, T.LongType),
    T.IntegerType: (T.LongType,),
    T.FloatType: (T.DoubleType,),
}


def _fits(given: T.DataType, kept: T.DataType) -> bool:
    """Whether every value of the given type is a value of the kept one."""
    if isinstance(given, T.DecimalType) and isinstance(kept, T.DecimalType):
        return given.scale <= kept.scale and given.precision - given.scale <= kept.precision - kept.scale
    return given.simpleString() == kept.simpleString() or isinstance(kept, _WIDER.get(type(given), ()))


def _require_same_columns(table: str, target: DataFrame, source: DataFrame) -> None:
    kept = {f.name: f.dataType for f in target.schema.fields}
    given = {f.name: f.dataType for f in source.schema.fields}
    wrong = [f"{n} is not in the table" for n in given.keys() - kept.keys()]
    wrong += [f"{n} is not in the batch" for n in kept.keys() - given.keys()]
    wrong += [
        f"{n} is {given[n].simpleString()}, the table has {kept[n].simpleString()}"
        for n in given.keys() & kept.keys()
        if not _fits(given[n], kept[n])
    ]
    if wrong:
        raise SchemaChanged(f"the batch does not fit {table}: {', '.join(sorted(wrong))}")


def _same(one: Column, other: Column, null_keys: bool) -> Column:
    return one.eqNullSafe(other) if null_keys else one == other


def merged(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    matched: Mapping[str, str],
    inserted: Mapping[str, str],
    null_keys: bool = False,
) -> DataFrame:
    """The target after the merge, lazily.

    `matched` gives the new value of a column for rows on both sides, `inserted` for rows of the
    source only, as SQL over `t.` and `s.`. Other columns keep their value, or are null when new. A null key
    matches nothing, or with `null_keys` another null.
    """
    t = target.withColumn("__in_t", F.lit(True)).alias("t")
    s = source.withColumn("__in_s", F.lit(True)).alias("s")
    on = [_same(F.col(f"t.{k}"), F.col(f"s.{k}"), null_keys) for k in keys]
    joined = t.join(s, on, "full_outer")
    in_t, in_s = F.col("t.__in_t").isNotNull(), F.col("s.__in_s").isNotNull()
    columns = []
    for field in target.schema.fields:
        name = field.name
        old = F.col(f"t.`{name}`")
        updated = F.expr(matched[name]) if name in matched else old
        new = F.expr(inserted[name]) if name in inserted else F.lit(None)
        value = F.when(in_t & in_s, updated).when(in_t, old).otherwise(new)
        columns.append(value.cast(field.dataType).alias(name, metadata=field.metadata))
    return joined.select(*columns)


def merge_into(
    spark: SparkSession,
    table: str,
    source: DataFrame,
    keys: Sequence[str],
    matched: Mapping[str, str],
    inserted: Mapping[str, str],
    null_keys: bool = False,
) -> None:
    """Apply `source` to `table`; raises before writing when a target row has several source rows.

    The table keeps its partitioning, comments and properties. If its partition columns are part of the
    key, only the partitions that the source names are read and rewritten. Otherwise the keys are looked up in
    the table, only the files that hold one of the batch are read as a whole and replaced, and new keys come in a file of their
    own. With more than `MOST_NAMES` such partitions or files, a bucketed table or one without files, the whole table is
    rewritten; buckets stay.

    The source is computed once, into `<table>__batch_<run>`. The merged rows are complete in
    `<table>__next_<run>` (and the names of the files they replace in `<table>__gone_<run>`) before the table is
    touched; a run that stops while they are put in place is finished by the next one. While one run
    writes, another is refused.
    """
    staged.refuse_if_busy(spark, table)
    parts = staged.partitioning(spark, table)
    buckets = None if parts else staged.bucketing(spark, table)
    run = staged.new_run()
    batch, following = f"{table}__batch_{run}", f"{table}__next_{run}"
    gone = staged.gone_beside(following)
    narrow = bool(parts) and set(parts) <= set(keys)
    try:
        staged.write(source, batch, parts if narrow and set(parts) < set(source.columns) else ())
        changes, target = spark.table(batch), spark.table(table)
        touched = _touched(changes, parts) if narrow else None
        how = staged.PARTITIONS if touched is not None else staged.REPLACE
        if touched is not None:
            target = target.where(touched)
        elif buckets is None and (files := _touched_files(spark, table, changes, keys, gone, null_keys)) is not None:
            target, how = target.where(F.col("_metadata.file_path").isin(files)), staged.FILES
        _refuse_ambiguous(target, changes, keys, null_keys)
        staged.write(merged(target, changes, keys, matched, inserted, null_keys), following, parts, buckets)
        if how == staged.REPLACE:
            staged.finish(spark, table, following, keep=True)
        else:
            staged.commit(spark, table, following, how)
    except Exception:
        if staged._drop_unless_ready(spark, following):
            spark.sql(f"DROP TABLE IF EXISTS {gone}")
        raise
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {batch}")


def merge_upsert(spark: SparkSession, table: str, source: DataFrame, keys: Sequence[str]) -> None:
    """Update every column of matched rows, insert the other source rows.

    The batch must have the table's columns, of the same types or of narrower ones; else it is refused.
    """
    staged.recover(spark, table)
    _require_same_columns(table, spark.table(table), source)
    every = {name: f"s.`{name}`" for name in source.columns}
    merge_into(spark, table, source, keys, every, every)


def merge_states(spark: SparkSession, table: str, kind: Maintained, batch: DataFrame, sign: str | None = None) -> None:
    """Add a batch to a table of maintained aggregates, creating it from the first one.

    Null keys are groups like any other. Types follow the first batch's sums; a sum that outgrows them stops the merge.
    """
    states = kind.states(batch, sign)
    staged.recover(spark, table)
    if not spark.catalog.tableExists(table):
        staged.replace(states, table)
        return
    new = {name: f"s.`{name}`" for name in states.columns}
    merge_into(spark, table, states, kind.keys, kind.added(), new, null_keys=True)


def merge_increment(
    spark: SparkSession, table: str, changes: DataFrame, key: str, balance: str, change: str
) -> None:
    """Add each change to its balance; an unknown key starts at its change."""
    merge_into(
        spark,
        table,
        changes,
        [key],
        matched={balance: f"t.`{balance}` + s.`{change}`"},
        inserted={key: f"s.`{key}`", balance: f"s.`{change}`"},
    )


def create_or_merge(
    spark: SparkSession,
    table: str,
    batch: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str] = (),
) -> None:
    """Create the table, partitioned as given, from the first batch; merge every later one."""
    if not set(partition_by) <= set(keys):
        raise ValueError("the partition columns must be part of the merge key")
    staged.recover(spark, table)
    if spark.catalog.tableExists(table):
        merge_upsert(spark, table, batch, keys)
    else:
        _writer(batch, "overwrite", partition_by).saveAsTable(table)


def _touched(changes: DataFrame, parts: Sequence[str]) -> Column | None:
    """A condition on partition columns alone that holds for the partitions of `changes`; none for too many.

    The list has one entry per partition of the batch, as a catalogue lists them; Spark evaluates the
    condition on the table's partitions before it reads any.
    """
    name = F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("null")) for p in parts])
    names = [row[0] for row in changes.select(name.alias("p")).distinct().limit(MOST_NAMES + 1).collect()]
    return name.isin(names) if len(names) <= MOST_NAMES else None


def _touched_files(
    spark: SparkSession, table: str, changes: DataFrame, keys: Sequence[str], gone: str, null_keys: bool
) -> list[str] | None:
    """The table's files that hold a key of `changes`, saved in `gone`; none for a table without files, or too many.

    Only the key columns are read; where the file format has them, the batch's least and greatest key let whole files be skipped.
    """
    provider = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Provider'").first()
    if provider is None or provider["data_type"].lower() not in ("parquet", "orc"):
        return None
    bounds = changes.agg(*[f(k).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("least", F.min), ("most", F.max))]).first()
    located = spark.table(table).select(*keys, F.col("_metadata.file_path").alias("path"))
    for i, key in enumerate(keys):
        if isinstance(changes.schema[key].dataType, (T.IntegralType, T.StringType, T.DateType)) and bounds[f"least_{i}"] is not None:
            within = F.col(key).between(bounds[f"least_{i}"], bounds[f"most_{i}"])
            located = located.where(within | F.col(key).isNull() if null_keys else within)
    held = _semi(located, changes, keys, null_keys).select("path").distinct()
    staged.write(held, gone)
    names = [row["path"] for row in spark.table(gone).limit(MOST_NAMES + 1).collect()]
    if len(names) <= MOST_NAMES:
        return names
    spark.sql(f"DROP TABLE {gone}")
    return None
