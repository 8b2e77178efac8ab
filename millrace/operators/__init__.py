"""Reusable table operators: DataFrames in, DataFrames out.

They run no action, except that `enrich_small` measures its dimension before it hints a broadcast.
"""
