"""Operators on DataFrames of objects, sets, features and scores."""
