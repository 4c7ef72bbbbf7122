"""Operators on DataFrames of records, pairs and scores."""
