"""Writers: Parquet, CSV and per-class exports."""
