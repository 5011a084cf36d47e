"""Relational operators: DataFrames in, DataFrames out, columns and vocabularies as parameters."""
