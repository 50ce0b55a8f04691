"""Readers and writers: CSV, Parquet, archives, fitted parameters, reports."""
