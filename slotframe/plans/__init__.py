"""Fixture binding, query registration and the analysis runner."""
