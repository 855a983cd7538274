"""Training-data operators: quality, language, tokens, duplicates, contamination, PII, mixing.

Every operator takes DataFrames and returns a DataFrame; nothing outside this
subpackage imports it.
"""
