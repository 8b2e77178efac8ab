"""Column expressions. Every function takes and returns Columns, so Spark plans and code-generates them."""
