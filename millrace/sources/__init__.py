"""Reading tables, parquet feeds and text feeds."""
