"""Aggregates that are kept up by batches: stored partial sums, from which reports are derived."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group so far: added ones less those taken back.
ROWS = "rows"


def values_of(name: str) -> str:
    """The column that counts the values of a kept sum."""
    return f"{name}_values"


@dataclass(frozen=True)
class Maintained:
    """Sums and counts per key, as a table of states that batches are added to.

    `sums` and `counts` name the columns whose sum or non-null count is kept. A sum comes with the count of its values,
    which averages need and which tells a sum of nothing (null) from one of zero. A batch may take rows back: its column `sign` is 1 for added rows and -1 for those that a correction removes. A
    group whose rows are all taken back is no longer in the report.
    """

    keys: Sequence[str]
    sums: Mapping[str, str]
    counts: Mapping[str, str]

    @property
    def names(self) -> list[str]:
        return [*self.sums, *map(values_of, self.sums), *self.counts, ROWS]

    def states(self, batch: DataFrame, sign: str | None = None) -> DataFrame:
        """The batch's own states, combined before they are shuffled; the same for one batch as for its parts added up."""
        way = F.lit(1) if sign is None else F.col(sign)
        found = [F.sum(F.col(c) * way).alias(name) for name, c in self.sums.items()]
        counts = {**{values_of(name): c for name, c in self.sums.items()}, **self.counts}
        found += [F.sum(F.when(F.col(c).isNotNull(), way).otherwise(0)).cast("bigint").alias(name) for name, c in counts.items()]
        return batch.groupBy(*self.keys).agg(*found, F.sum(way).cast("bigint").alias(ROWS))

    def added(self) -> dict[str, str]:
        """New values of a stored state, as SQL over `t.` (stored) and `s.` (batch)."""
        return {n: f"coalesce(t.`{n}` + s.`{n}`, t.`{n}`, s.`{n}`)" for n in self.names}

    def total(self, name: str) -> Column:
        """A kept sum, null if no value is in it."""
        return F.when(F.col(values_of(name)) > 0, F.col(name))

    def average(self, name: str) -> Column:
        return F.try_divide(self.total(name), F.col(values_of(name)))

    def report(self, states: DataFrame, *derived: Column) -> DataFrame:
        """Keys and derived columns of the groups that have rows."""
        return states.where(F.col(ROWS) > 0).select(*self.keys, *derived)
