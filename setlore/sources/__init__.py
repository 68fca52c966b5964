"""Readers and parsers that turn files and documents into DataFrames."""
