"""Operators: each takes DataFrames and returns a lazy DataFrame; none runs a job by itself."""
