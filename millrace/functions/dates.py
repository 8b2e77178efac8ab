"""Month arithmetic on date columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col


def month_of(c: Column | str) -> Column:
    return F.trunc(col(c), "month")


def month_start(day: date) -> date:
    return day.replace(day=1)


def age_in_days(as_of: date, c: Column | str) -> Column:
    return F.datediff(F.lit(as_of), col(c))
