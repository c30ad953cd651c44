"""Writers: catalog tables, Parquet, CSV and report files."""
