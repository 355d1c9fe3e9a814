"""Readers: driver parquet tables (tables) and the reference file formats (files)."""
