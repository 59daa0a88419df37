"""Scans and sinks: bundle directories, parquet test tables, report files."""
