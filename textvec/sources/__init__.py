"""Weight files as DataFrames, and weights as Parquet packs."""
