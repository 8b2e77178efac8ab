"""Batch table jobs and the reusable DataFrame operators under them."""
