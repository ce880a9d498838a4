"""Detection and annotation analytics on Spark DataFrames."""
