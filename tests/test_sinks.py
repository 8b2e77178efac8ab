from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.checks.gates import GateFailed
from millrace.sinks import merge, scratch, staged, tables
from millrace.sources import readers


def test_overwrite_is_idempotent_and_changes_the_schema(spark, schema, rows_of):
    table = f"{schema}.t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        tables.overwrite(df, table)
    assert rows_of(spark.table(table)) == [(1, "a"), (2, "b")]
    tables.overwrite(df.withColumn("w", F.lit(True)), table)
    assert spark.table(table).columns == ["id", "v", "w"]


def test_a_published_schema_is_guarded_before_anything_is_written(spark, schema, rows_of):
    table = f"{schema}.t"
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    tables.overwrite_same_schema(df, table)
    for changed in (df.drop("v"), df.withColumn("id", F.col("id").cast("bigint")), df.select("v", "id")):
        with pytest.raises(tables.SchemaChanged):
            tables.overwrite_same_schema(changed, table)
    assert rows_of(spark.table(table)) == [(1, "a")]
    tables.overwrite_same_schema(spark.createDataFrame([(2, "b")], "id int, v string"), table)
    assert rows_of(spark.table(table)) == [(2, "b")]


def test_append_adds_rows_by_column_name(spark, schema, rows_of):
    table = f"{schema}.t"
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    tables.append(df, table)
    tables.append(df.select("v", "id"), table)
    assert rows_of(spark.table(table)) == [(1, "a"), (1, "a")]
    with pytest.raises(tables.SchemaChanged):
        tables.append(df.drop("v"), table)


def test_a_partitioned_overwrite_keeps_every_row(spark, schema):
    df = spark.range(200).select("id", (F.col("id") % 5).alias("p"))
    tables.overwrite(df, f"{schema}.t", ["p"])
    assert spark.table(f"{schema}.t").groupBy("p").count().where("count = 40").count() == 5


def test_landing_adds_the_source_and_counts(spark, schema, rows_of):
    df = spark.createDataFrame([("1",), ("1",)], "id string")
    assert tables.land(df, f"{schema}.bronze", "crm.Account") == 2
    assert rows_of(spark.table(f"{schema}.bronze")) == [("1", "crm.Account")] * 2


RULE = "txn_type = 'refund' OR amount >= 0"


@pytest.mark.parametrize("bad", [("charge", -1.0), ("charge", None), (None, None)])
def test_a_broken_row_rule_stops_the_write(spark, schema, rows_of, bad):
    table = f"{schema}.clean"
    good = spark.createDataFrame([("refund", -5.0), ("charge", 0.0)], "txn_type string, amount double")
    tables.write_checked(good, table, RULE)
    with pytest.raises(GateFailed, match="1 row"):
        tables.write_checked(good.union(spark.createDataFrame([bad], good.schema)), table, RULE)
    assert rows_of(spark.table(table)) == rows_of(good)


def test_scratch_tables_go_to_the_shared_folder(spark):
    name = scratch.scratch_database(spark)
    location = spark.sql(f"DESCRIBE DATABASE {name}").where("info_name = 'Location'").first()[1]
    assert location.replace("file:", "") == f"{spark.conf.get('spark.checkpoint.dir')}/{name}"


def test_no_scratch_database_is_left(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    scratch.release(spark)
    with scratch.cleared(spark):
        name = scratch.scratch_database(spark)
        spark.range(3).write.saveAsTable(f"{name}.t")
        spark.range(3).write.parquet(scratch.scratch_path(spark, "rows"))
        assert list(folder.glob("millrace_*"))
    assert not list(folder.glob("millrace_*"))
    assert not [d.name for d in spark.catalog.listDatabases() if d.name.startswith("millrace_")]


def test_a_session_that_hides_its_master_is_no_local_one():
    class Hidden:
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_folder(Hidden)


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    class Cluster:
        conf = {"spark.master": master}

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_folder(Cluster)


def test_a_missing_feed_is_named(spark, tmp_path):
    with pytest.raises(readers.FeedMissing, match="nowhere"):
        readers.scan_parquet(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(readers.FeedMissing, match="empty"):
        readers.scan_parquet(spark, str(tmp_path / "empty"))
    with pytest.raises(readers.FeedMissing, match="nowhere"):
        readers.scan_text_feed(spark, str(tmp_path / "nowhere"), ["a"])


def test_a_text_feed_keeps_blanks_and_text(spark, tmp_path, rows_of):
    (tmp_path / "feed.csv").write_text('a,b\n007,\n"1,5 kg",x\n')
    feed = readers.scan_text_feed(spark, str(tmp_path / "feed.csv"), ["a", "b"])
    assert rows_of(feed) == [("007", ""), ("1,5 kg", "x")]


def test_day_slice(spark, rows_of):
    df = spark.createDataFrame([("2026-08-30", 1), ("2026-08-31", 2)], "d string, v int")
    assert rows_of(readers.day_slice(df, "d", "2026-08-30")) == [("2026-08-30", 1)]


# Merging

TARGET = "k int, p int, v string, w int"


def random_merge(seed):
    rng = random.Random(seed)
    target = {(k, k % 4): (rng.choice("abc"), rng.randint(0, 9)) for k in rng.sample(range(40), 25)}
    source = {
        (k, k % 4): (rng.choice(["x", None]), rng.randint(0, 9)) for k in rng.sample(range(40), 15)
    }
    return target, source


def as_rows(mapping):
    return [(*key, *value) for key, value in mapping.items()]


@pytest.mark.parametrize("partition_by", [[], ["p"]])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upsert_equals_a_dictionary_update(spark, schema, rows_of, partition_by, seed):
    target, source = random_merge(seed)
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame(as_rows(target), TARGET), table, partition_by)
    batch = spark.createDataFrame(as_rows(source), TARGET)
    merge.merge_upsert(spark, table, batch, ["k", "p"])
    expected = sorted(as_rows({**target, **source}), key=repr)
    assert rows_of(spark.table(table).select("k", "p", "v", "w")) == expected
    merge.merge_upsert(spark, table, batch, ["k", "p"])
    assert rows_of(spark.table(table).select("k", "p", "v", "w")) == expected


def test_only_touched_partitions_are_rewritten(spark, schema):
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, 1, "a", 1), (2, 2, "a", 1)], TARGET), table, ["p"])

    def files(partition):
        return {r[0] for r in spark.table(table).where(f"p = {partition}").select("_metadata.file_path").collect()}

    kept, replaced = files(1), files(2)
    batch = spark.createDataFrame([(2, 2, "b", 2), (3, 2, "c", 3)], TARGET)
    merge.merge_upsert(spark, table, batch, ["k", "p"])
    assert files(1) == kept and not files(2) & replaced
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_rows_of_a_null_partition_survive(spark, schema, rows_of):
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, None, "a", 1), (2, 2, "b", 2)], TARGET), table, ["p"])
    batch = spark.createDataFrame([(9, None, "n", 9), (2, 2, "c", 3)], TARGET)
    merge.merge_upsert(spark, table, batch, ["k", "p"])
    assert rows_of(spark.table(table).select("k", "v")) == [(1, "a"), (2, "c"), (9, "n")]


def test_any_number_of_partitions_is_touched_by_name(spark, schema):
    table = f"{schema}.t"
    rows = spark.range(1101).select(F.col("id").cast("int").alias("k"), F.col("id").cast("int").alias("p"), F.lit("a").alias("v"), F.lit(1).alias("w"))
    tables.overwrite(rows.coalesce(1), table, ["p"])
    batch = rows.where("p < 1050").withColumn("v", F.lit("b"))
    merge.merge_upsert(spark, table, batch.coalesce(1), ["k", "p"])
    counts = {r["v"]: r["count"] for r in spark.table(table).groupBy("v").count().collect()}
    assert counts == {"a": 51, "b": 1050}


def test_several_partition_columns_limit_the_scan(spark, schema, rows_of):
    table = f"{schema}.t"
    rows = [(i, i % 3, None if i % 5 == 0 else f"q{i % 2}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, p int, q string, w int")
    tables.overwrite(df, table, ["p", "q"])
    batch = df.where("k in (0, 4)").withColumn("w", F.lit(99))
    changes = batch.select("p", "q").distinct()
    touched = spark.table(table).where(merge._touched(changes, ["p", "q"]))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws" in plan
    merge.merge_upsert(spark, table, batch, ["k", "p", "q"])
    expected = [(k, p, q, 99 if k in (0, 4) else w) for k, p, q, w in rows if q is not None or k != 0]
    # A null in the key matches nothing, so the row of key 0 is inserted beside its old version.
    expected += [(0, 0, None, 0), (0, 0, None, 99)]
    assert rows_of(spark.table(table).select("k", "p", "q", "w")) == sorted(expected, key=repr)


def test_a_merge_keeps_partitioning_comments_and_properties(spark, schema, rows_of):
    table = f"{schema}.t"
    spark.sql(f"""CREATE TABLE {table} (k INT COMMENT 'the key', v STRING, p INT) USING parquet
        PARTITIONED BY (p) COMMENT 'kept' TBLPROPERTIES ('owner.team' = 'x')""")
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int").write.insertInto(table)
    merge.merge_upsert(spark, table, spark.createDataFrame([(1, "c", 2), (3, "d", 3)], "k int, v string, p int"), ["k"])
    assert rows_of(spark.table(table)) == [(1, "c", 2), (2, "b", 2), (3, "d", 3)]
    assert staged.partitioning(spark, table) == ["p"]
    found = staged.properties(spark, table)
    assert found["owner.team"] == "x" and found["comment"] == "kept"
    assert {c.name: c.description for c in spark.catalog.listColumns(table)}["k"] == "the key"
    assert not [k for k in found if k.startswith(staged.READY)]


@pytest.mark.parametrize(
    "batch, schema_of_batch, told",
    [
        ((1, "b", 1, 2, "x"), "k int, v string, p int, w int, extra string", "extra is not in the table"),
        ((1, "b", 1), "k int, v string, p int", "w is not in the batch"),
        ((1, "b", 1, 2**40), "k int, v string, p int, w bigint", "w is bigint"),
    ],
)
def test_a_batch_of_other_columns_is_refused(spark, schema, rows_of, batch, schema_of_batch, told):
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, 1, "a", 1)], TARGET), table)
    with pytest.raises(tables.SchemaChanged, match=told):
        merge.merge_upsert(spark, table, spark.createDataFrame([batch], schema_of_batch), ["k"])
    assert rows_of(spark.table(table)) == [(1, 1, "a", 1)]


def test_a_finer_decimal_is_refused_and_a_narrower_one_taken(spark, schema, rows_of):
    table = f"{schema}.t"
    tables.overwrite(spark.sql("SELECT 1 AS k, CAST(1.5 AS DECIMAL(10,2)) AS v"), table)
    with pytest.raises(tables.SchemaChanged, match=r"decimal\(10,3\)"):
        merge.merge_upsert(spark, table, spark.sql("SELECT 1 AS k, CAST(1.239 AS DECIMAL(10,3)) AS v"), ["k"])
    merge.merge_upsert(spark, table, spark.sql("SELECT 1 AS k, CAST(1.2 AS DECIMAL(5,1)) AS v"), ["k"])
    assert [str(r["v"]) for r in spark.table(table).collect()] == ["1.20"]


@pytest.mark.parametrize("lost", [[], [1], [1, 2]])
def test_a_commit_that_stopped_between_folders_is_replayed(spark, schema, rows_of, monkeypatch, lost):
    """The run dies in the commit, after some of the touched partitions were removed."""
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, 1, "a", 1), (2, 2, "b", 1), (3, 3, "c", 1)], TARGET), table, ["p"])

    def dies(spark, name, following, how):
        for part in lost:
            spark.sql(f"ALTER TABLE {name} DROP PARTITION (p = {part})")
        raise RuntimeError("executor lost")

    batch = spark.createDataFrame([(1, 1, "x", 2), (4, 2, "y", 2)], TARGET)
    with monkeypatch.context() as patch:
        patch.setattr(staged, "_apply", dies)
        with pytest.raises(RuntimeError):
            merge.merge_upsert(spark, table, batch, ["k", "p"])
    merge.merge_upsert(spark, table, spark.createDataFrame([(3, 3, "z", 3)], TARGET), ["k", "p"])
    expected = [(1, 1, "x", 2), (2, 2, "b", 1), (3, 3, "z", 3), (4, 2, "y", 2)]
    assert rows_of(spark.table(table).select("k", "p", "v", "w")) == expected
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


def test_a_replacement_that_stopped_is_finished_by_the_next_run(spark, schema, rows_of, monkeypatch):
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, "a")], "k int, v string"), table)

    def dies(spark, name, following, how):
        spark.sql(f"DROP TABLE {name}")
        raise RuntimeError("driver lost")

    both = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with monkeypatch.context() as patch:
        patch.setattr(staged, "_apply", dies)
        with pytest.raises(RuntimeError):
            tables.recreate(both, table)
    merge.create_or_merge(spark, table, spark.createDataFrame([(3, "c")], "k int, v string"), ["k"])
    assert rows_of(spark.table(table)) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_second_merge_is_refused_while_one_is_open(spark, schema, rows_of):
    table = f"{schema}.t"
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.overwrite(df, table)
    tables.overwrite(df, f"{table}__next_0123456789ab")
    tables.overwrite(df, f"{table}__next")  # a table of the user's own
    with pytest.raises(staged.TableBusy):
        merge.merge_upsert(spark, table, df, ["k"])
    staged.abandon(spark, table)
    merge.merge_upsert(spark, table, df, ["k"])
    assert rows_of(spark.table(f"{table}__next")) == [(1, "a")]


@pytest.mark.parametrize("partition_by", [[], ["p"]])
def test_a_table_may_be_recreated_from_itself(spark, schema, rows_of, partition_by):
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, 1, "a", 1), (2, 2, "b", 1)], TARGET), table, partition_by)
    tables.recreate(spark.table(table).where("k = 2").select("k", "p", "v"), table, partition_by)
    assert rows_of(spark.table(table).select("k", "p", "v")) == [(2, 2, "b")]


def test_a_failing_write_leaves_the_old_table(spark, schema, rows_of):
    table = f"{schema}.t"
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.overwrite(df, table)
    broken = df.withColumn("k", F.raise_error(F.lit("no")).cast("int"))
    for write in (lambda: tables.recreate(broken, table), lambda: tables.write_checked(broken, table, "true")):
        with pytest.raises(Exception, match="no"):
            write()
        assert rows_of(spark.table(table)) == [(1, "a")]
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


def test_the_input_of_a_checked_write_is_computed_once(spark, schema):
    counter = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(spark.sparkContext.parallelize(range(10)).map(lambda i: (counter.add(1), (i,))[1]), "k int")
    tables.write_checked(df, f"{schema}.t", "k >= 0")
    assert counter.value == 10


def test_several_source_rows_for_one_target_row_are_refused(spark, schema, rows_of):
    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), table)
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    with pytest.raises(merge.AmbiguousMerge, match="1"):
        merge.merge_upsert(spark, table, twice, ["k"])
    assert rows_of(spark.table(table)) == [(1, "a"), (2, "b")]
    new = spark.createDataFrame([(7, "x"), (7, "y"), (None, "n")], "k int, v string")
    merge.merge_upsert(spark, table, new, ["k"])
    assert rows_of(spark.table(table)) == [(1, "a"), (2, "b"), (7, "x"), (7, "y"), (None, "n")]


def test_increments_add_and_insert(spark, schema, rows_of):
    table = f"{schema}.balances"
    start = [("C1", 250.0, "North"), ("C2", 1200.5, "South"), ("C3", None, "West")]
    tables.overwrite(spark.createDataFrame(start, "customer_id string, balance double, region string"), table)
    changes = spark.createDataFrame(
        [("C1", 50.0), ("C2", -200.0), ("C3", 1.0), ("C9", 5.0)], "customer_id string, change_amount double"
    )
    merge.merge_increment(spark, table, changes, "customer_id", "balance", "change_amount")
    assert rows_of(spark.table(table)) == [
        ("C1", 300.0, "North"), ("C2", 1000.5, "South"), ("C3", None, "West"), ("C9", 5.0, None),
    ]


def test_create_then_merge(spark, schema, rows_of):
    table = f"{schema}.t"
    merge.create_or_merge(spark, table, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])
    batch = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    merge.create_or_merge(spark, table, batch, ["k"])
    assert rows_of(spark.table(table)) == [(1, "b"), (2, "c")]


def test_the_partition_must_be_part_of_the_key(spark, schema):
    table = f"{schema}.t"
    df = spark.createDataFrame([(1, 1, "a", 1)], TARGET)
    with pytest.raises(ValueError, match="part of the merge key"):
        merge.create_or_merge(spark, table, df, ["k"], ["p"])


def files_of(spark, table, where="true"):
    return {r[0] for r in spark.table(table).where(where).select("_metadata.file_path").distinct().collect()}


def test_a_merge_rewrites_only_files_that_hold_a_key(spark, schema, rows_of):
    table = f"{schema}.t"
    rows = spark.range(0, 1000, 1, 100).select("id", (F.col("id") * 2).alias("v"))
    rows.write.saveAsTable(table)
    before = files_of(spark, table)
    batch = spark.range(0, 1000, 211).select("id", F.lit(-1).cast("bigint").alias("v")).union(spark.sql("SELECT 5000L, 7L"))
    merge.merge_upsert(spark, table, batch, ["id"])
    after = files_of(spark, table)
    assert len(before) == 100 and len(before - after) == 5
    expected = [(i, -1 if i % 211 == 0 else 2 * i) for i in range(1000)] + [(5000, 7)]
    assert rows_of(spark.table(table)) == sorted(expected, key=repr)
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]
    merge.merge_increment(spark, table, spark.sql("SELECT 5000L AS id, 1L AS more"), "id", "v", "more")
    assert len(after - files_of(spark, table)) == 1
    assert spark.table(table).where("id = 5000").first()["v"] == 8


def test_a_merge_may_move_rows_to_other_partitions(spark, schema, rows_of):
    table = f"{schema}.t"
    start = [(i, i % 3, f"v {i}", i) for i in range(9)]
    tables.overwrite(spark.createDataFrame(start, TARGET).coalesce(1), table, ["p"])
    kept = files_of(spark, table, "p = 2")
    batch = spark.createDataFrame([(0, 7, "moved", 1), (3, None, "moved", 2), (50, 1, "new", 3)], TARGET)
    merge.merge_upsert(spark, table, batch, ["k"])
    expected = [r for r in start if r[0] not in (0, 3)] + [(0, 7, "moved", 1), (3, None, "moved", 2), (50, 1, "new", 3)]
    assert rows_of(spark.table(table).select("k", "p", "v", "w")) == sorted(expected, key=repr)
    assert files_of(spark, table, "p = 2") == kept
    assert spark.table(table).where("p = 7").count() == 1


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_an_exchange_of_files_that_stopped_is_replayed(spark, schema, rows_of, monkeypatch, moved):
    import shutil
    from pathlib import Path

    table = f"{schema}.t"
    tables.overwrite(spark.createDataFrame([(1, 1, "a", 1), (2, 2, "b", 1), (3, 3, "c", 1)], TARGET), table, ["p"])

    def dies(spark, name, following, how):
        assert how == staged.FILES
        source, target = (Path(staged.location(spark, t).removeprefix("file:")) for t in (following, name))
        for path in sorted(source.rglob("part-*"))[:moved]:
            place = target / path.relative_to(source)
            place.parent.mkdir(exist_ok=True)
            shutil.move(path, place)
        raise RuntimeError("driver lost")

    batch = spark.createDataFrame([(1, 1, "x", 2), (4, 9, "y", 2)], TARGET)
    with monkeypatch.context() as patch:
        patch.setattr(staged, "_apply", dies)
        with pytest.raises(RuntimeError):
            merge.merge_upsert(spark, table, batch, ["k"])
    merge.merge_upsert(spark, table, spark.createDataFrame([(3, 3, "z", 3)], TARGET), ["k"])
    expected = [(1, 1, "x", 2), (2, 2, "b", 1), (3, 3, "z", 3), (4, 9, "y", 2)]
    assert rows_of(spark.table(table).select("k", "p", "v", "w")) == expected
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


def test_too_many_files_or_partitions_are_not_listed(spark, schema, rows_of, monkeypatch):
    monkeypatch.setattr(merge, "MOST_NAMES", 1)
    for parts, keys in (([], ["k"]), (["p"], ["k", "p"])):
        table = f"{schema}.t{len(parts)}"
        rows = [(k, k % 3, "a", 1) for k in range(6)]
        tables.overwrite(spark.createDataFrame(rows, TARGET).repartition(3, "p"), table, parts)
        merge.merge_upsert(spark, table, spark.createDataFrame([(k, p, "b", w) for k, p, _, w in rows[:3]], TARGET), keys)
        expected = [(k, p, "b" if k < 3 else "a", w) for k, p, _, w in rows]
        assert rows_of(spark.table(table).select("k", "p", "v", "w")) == expected
    assert sorted(t.name for t in spark.catalog.listTables(schema)) == ["t0", "t1"]


def refuse(rows):
    raise GateFailed(f"{rows.count()} rows looked at")


@pytest.mark.parametrize("partition_by", [[], ["v"]])
def test_a_failing_write_or_audit_leaves_every_table(spark, schema, rows_of, partition_by):
    table = f"{schema}.t"
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.overwrite(df, table, partition_by)
    broken = df.withColumn("k", F.raise_error(F.lit("no")).cast("int"))
    for write in (tables.overwrite, tables.overwrite_same_schema):
        with pytest.raises(Exception, match="no"):
            write(broken, table, partition_by)
        with pytest.raises(GateFailed, match="2 rows looked at"):
            write(df.union(df), table, partition_by, audit=refuse)
        assert rows_of(spark.table(table)) == [(1, "a")]
        write(spark.table(table).union(df), table, partition_by)  # reading itself
        write(df, table, partition_by)
    assert rows_of(spark.table(table)) == [(1, "a")]
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


def test_landing_that_fails_leaves_the_old_delivery(spark, schema, rows_of):
    table = f"{schema}.bronze"
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.land(df, table, "x")
    with pytest.raises(Exception, match="no"):
        tables.land(df.withColumn("k", F.raise_error(F.lit("no")).cast("int")), table, "x")
    assert rows_of(spark.table(table)) == [(1, "a", "x")]


def test_a_day_is_landed_in_its_own_place(spark, schema, rows_of):
    table = f"{schema}.bronze"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for day in ("2026-08-30", "2026-08-31"):
        assert tables.land_slice(df, table, "x", "day", day) == 2
    kept = files_of(spark, table, "day = '2026-08-30'")
    again = df.where("k = 1").withColumn("v", F.lit("corrected"))
    tables.land_slice(again, table, "x", "day", "2026-08-31")
    assert files_of(spark, table, "day = '2026-08-30'") == kept
    assert rows_of(spark.table(table).where("day = '2026-08-31'")) == [(1, "corrected", "x", "2026-08-31")]
    plan = spark.table(table).where("day = '2026-08-31'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    for failing in (lambda: tables.replace_slice(again.drop("v"), table, "day", "2026-08-31"),):
        with pytest.raises(tables.SchemaChanged):
            failing()
    with pytest.raises(GateFailed):
        tables.replace_slice(again.withColumn("source_object", F.lit("y")), table, "day", "2026-08-31", audit=refuse)
    assert spark.table(table).count() == 3
    assert tables.land_slice(df.limit(0), table, "x", "day", "2026-08-31") == 0
    assert spark.table(table).count() == 2 and files_of(spark, table) == kept
    assert [t.name for t in spark.catalog.listTables(schema)] == ["bronze"]


def test_a_view_of_a_copys_name_does_not_make_a_table_busy(spark, schema):
    table = f"{schema}.t"
    spark.range(3).createOrReplaceTempView("t__next_0123456789ab")
    try:
        tables.overwrite(spark.range(2), table)
        merge.merge_upsert(spark, table, spark.range(1, 4), ["id"])
        assert spark.table(table).count() == 4
    finally:
        spark.catalog.dropTempView("t__next_0123456789ab")


def test_day_by_day_states_equal_a_full_recompute(spark, schema, rows_of):
    from millrace.plans import sales

    rng = random.Random(4)
    table = f"{schema}.states"
    columns = "store_id string, product_category string, sale_date string, revenue decimal(10,2), quantity int, transaction_id string"

    def row(n):
        return (rng.choice(["a", "b", None]), rng.choice(["x", "y"]), f"2026-01-0{rng.randint(1, 3)}", rng.choice([None, "1.25", "9.10"]), rng.choice([None, 1, 5]), rng.choice([None, f"t{n}"]))

    def frame(rows, sign):
        return spark.createDataFrame(rows, columns.replace("decimal(10,2)", "string")).withColumn("revenue", F.col("revenue").cast("decimal(10,2)")).withColumn("sign", F.lit(sign))

    kept = []
    for day in range(3):
        added = [row(10 * day + n) for n in range(20)]
        back = [kept.pop(rng.randrange(len(kept))) for _ in range(7 if kept else 0)]
        kept += added
        merge.merge_states(spark, table, sales.DAILY_STATES, frame(added, 1).union(frame(back, -1)), "sign")
    gone = [r for r in kept if r[0] is None]
    kept = [r for r in kept if r[0] is not None]
    merge.merge_states(spark, table, sales.DAILY_STATES, frame(gone, -1), "sign")
    once = frame(kept, 1)
    expected = sales.daily_sales(once).withColumn("avg_order_value", F.col("avg_order_value").cast("decimal(18,6)"))
    got = sales.daily_sales_of(spark.table(table)).select(*[F.col(c).cast(t) for c, t in expected.dtypes])
    assert rows_of(got) == rows_of(expected)


def test_tables_stored_by_key_are_joined_and_counted_where_they_lie(spark, schema, rows_of):
    headers = spark.range(200).select((F.col("id") % 97).alias("k"), F.col("id").alias("h")).dropDuplicates(["k"])
    items = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.col("id") % 103).alias("k"), "id")
    tables.overwrite_bucketed(headers, f"{schema}.headers", ["k"], 8)
    tables.overwrite_bucketed(items, f"{schema}.items", ["k"], 8)
    assert staged.bucketing(spark, f"{schema}.items") == staged.Buckets(["k"], 8)
    assert len(spark.table(f"{schema}.items").inputFiles()) <= 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            joined = spark.table(f"{schema}.headers").join(spark.table(f"{schema}.items"), ["k"])
            found = rows_of(joined)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert found == rows_of(headers.join(items, ["k"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counted = spark.table(f"{schema}.items").groupBy("k").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert rows_of(counted) == rows_of(items.groupBy("k").count())


def test_a_merge_keeps_the_buckets_of_a_table(spark, schema, rows_of):
    table = f"{schema}.t"
    tables.overwrite_bucketed(spark.range(50).select("id", F.lit("old").alias("v")), table, ["id"], 4)
    merge.merge_upsert(spark, table, spark.range(45, 55).select("id", F.lit("new").alias("v")), ["id"])
    assert rows_of(spark.table(table)) == sorted(((i, "old" if i < 45 else "new") for i in range(55)), key=repr)
    assert staged.bucketing(spark, table) == staged.Buckets(["id"], 4)


def test_a_failing_audit_keeps_the_old_bucketed_table(spark, schema, rows_of):
    table = f"{schema}.t"
    tables.overwrite_bucketed(spark.range(3), table, ["id"], 2)

    def refuse(rows):
        raise ValueError("no")

    with pytest.raises(ValueError):
        tables.overwrite_bucketed(spark.range(9), table, ["id"], 2, audit=refuse)
    assert spark.table(table).count() == 3
