"""Array-sensor analytics on Spark DataFrames."""
