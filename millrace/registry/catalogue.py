"""All queries by name. Importing the modules registers them."""

from millrace.registry import aggregates, checks, cleaning, io, joins, rows, windows  # noqa: F401
from millrace.registry.base import ORACLES, QUERIES  # noqa: F401
