"""A shared place for tables that one run writes and reads back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Scratch databases by application, the application's session with them.
_open: dict[str, tuple[SparkSession, list[str]]] = {}
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, which the cluster names.

    Only a local session, where driver and executors are one machine, may go without it. A session that
    does not tell its master counts as a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", None) or ""
    if master != "local" and not master.startswith("local["):  # executors of local-cluster are processes of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="millrace-")


def scratch_database(spark: SparkSession) -> str:
    """A new, empty database of its own folder below the shared one; returns its name.

    It stays until `release`, `cleared` or the end of the process, as results may still be read from it.
    """
    name = f"millrace_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark)}/{name}'")
    _open.setdefault(spark.sparkContext.applicationId, (spark, []))[1].append(name)
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the session's scratch folder, which goes with the scratch databases."""
    application = spark.sparkContext.applicationId
    if application not in _folders:
        name = scratch_database(spark)
        described = spark.sql(f"DESCRIBE DATABASE {name}").where("info_name = 'Location'").first()
        _folders[application] = described[1].rstrip("/")
    return f"{_folders[application]}/{label}_{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Drop all scratch databases of the session, with their tables and the scratch paths."""
    application = spark.sparkContext.applicationId
    _folders.pop(application, None)
    for name in _open.pop(application, (spark, []))[1]:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Release the session's scratch space at the end, whatever happens."""
    try:
        yield
    finally:
        release(spark)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_open.values()):
        with contextlib.suppress(Exception):  # the session may have ended before the process
            release(spark)
