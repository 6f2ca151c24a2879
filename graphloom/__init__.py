"""Graph cut and connectivity analytics on Spark DataFrames."""
