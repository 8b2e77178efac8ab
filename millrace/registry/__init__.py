"""Named queries over the standard tables, each with an equivalent DuckDB query where SQL has one."""
