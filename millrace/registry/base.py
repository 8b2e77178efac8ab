"""Registering queries and resolving their inputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry.views import VIEWS

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


class Inputs:
    """The tables of one folder, and the views derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, view: str) -> DataFrame:
        if view not in VIEWS:
            raise AttributeError(view)
        text = VIEWS[view]
        tables = {t: self.table(t) for t in _PLACEHOLDER.findall(text)}
        return self.spark.sql(text, **tables)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(views: Sequence[str], body: str) -> str:
    if not views:
        return body
    parts = [f"{v} AS ({_PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[v])})" for v in views]
    return f"WITH {', '.join(parts)} {body}"


def query(name: str, views: Sequence[str] = (), oracle: str | None = None):
    """Register a function of `Inputs` under `name`; `oracle` may use the views as tables."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle)
        return build

    return register


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Fix the result types that would otherwise follow the inputs' precision."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def half_up(numerator: str, denominator: str, scale: int, precision: int = 18) -> str:
    """SQL for an exact quotient of integers rounded half up (DuckDB divides decimals as doubles)."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    whole = f"((2 * abs({n}) * {10**scale} + {d}) // (2 * {d}))"
    return (
        f"CAST(sign({n}) * {whole} / {10**scale}.0 AS DECIMAL({precision},{scale}))"
    )
