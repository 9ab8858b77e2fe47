"""Parsers of the query languages and their translation into DataFrames."""
