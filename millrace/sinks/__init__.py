"""Writing tables: overwrite, append, landing, constraints and merges."""
