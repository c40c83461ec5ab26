"""Ledger analytics on PySpark: typed event tables, per-slot aggregates, idempotent sinks, audits and state."""
