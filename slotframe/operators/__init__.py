"""Operators over ledger views, and their queries."""
