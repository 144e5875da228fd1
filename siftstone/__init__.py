"""A columnar screening, scoring and ranking library for Spark DataFrames."""
