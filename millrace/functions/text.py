"""Text columns to clean or typed columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and the four ASCII separators.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WHOLE_NUMBER = r"^[+-]?[0-9]+(_[0-9]+)*$"

_YES = ("true", "yes", "1")
_NO = ("false", "no", "0")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing white space of every kind (Spark's `trim` removes spaces only)."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def blank_to_null(c: Column | str) -> Column:
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def upper_code(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def lower_code(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def title_case(c: Column | str) -> Column:
    return F.initcap(lower_code(c))


def is_yes(c: Column | str) -> Column:
    """True for a yes-like flag, false for any other text."""
    return lower_code(c).isin(*_YES)


def yes_no(c: Column | str) -> Column:
    """True or false for a recognised flag, null for any other text."""
    return F.when(is_yes(c), True).when(lower_code(c).isin(*_NO), False)


def lenient(c: Column | str, data_type: str) -> Column:
    """Typed value of a trimmed text, null where it cannot be read."""
    return F.trim(col(c)).try_cast(data_type)


def strict_date(c: Column | str) -> Column:
    """Date of a trimmed text; unreadable text raises."""
    return F.to_date(F.trim(col(c)))


def strict_date_or_null(c: Column | str) -> Column:
    """Date of a trimmed text, null for a blank; unreadable text raises."""
    return F.to_date(blank_to_null(c))


def whole_number_or_zero(c: Column | str) -> Column:
    """A text holding a whole number as a double; anything else, and null, is 0.

    Digits may be grouped with single underscores and the number may be of any size, hence double.
    """
    text = strip_ws(c)
    digits = F.regexp_replace(text, "_", "").try_cast("double")
    return F.when(text.rlike(_WHOLE_NUMBER), digits).otherwise(F.lit(0.0))


def email_domain(c: Column | str) -> Column:
    """The piece after the first `@`; null for a null address or one without `@`."""
    return F.get(F.split(col(c), "@"), 1)


def lookup(key: Column | str, table: Mapping[str, Any], data_type: str) -> Column:
    """Value of a fixed in-plan table, null for a null or unknown key."""
    names = F.array(*[F.lit(name) for name in table])
    values = F.array(*[F.lit(value).cast(data_type) for value in table.values()])
    return F.try_element_at(F.map_from_arrays(names, values), col(key))
