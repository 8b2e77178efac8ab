"""Data checks: gates that raise, and suites that report one row per check."""
