"""Content analytics on Spark DataFrames."""
