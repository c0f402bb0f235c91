"""Operators on graphs and on solutions (DataFrames with a column for each variable, NULL where it is unbound)."""
