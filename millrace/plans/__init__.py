"""The table jobs: each function builds one table from the tables before it."""
