"""Readers: Parquet datasets and fixed-width text dumps."""
