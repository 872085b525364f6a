"""Readers (CSV, parquet, test-data adapters) and writers."""
