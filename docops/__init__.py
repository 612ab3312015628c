"""Document-operations analytics on Spark DataFrames."""
