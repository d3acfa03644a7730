"""Readers and writers: text tables in, parquet or text out."""
