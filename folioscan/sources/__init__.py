"""Readers, writers and the Parquet catalog."""
