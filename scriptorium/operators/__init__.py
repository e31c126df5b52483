"""Operators on DataFrames: chunking, storing, searching, summarising and exporting."""
