"""Readers: delimited text, Parquet, workbooks, Stata files, catalog and file listings."""
