"""Readers: Parquet, CSV, raw text lines, batched JSON, mapping configs, query results."""
