"""Readers and writers of bibliographic text formats, as typed DataFrames."""
