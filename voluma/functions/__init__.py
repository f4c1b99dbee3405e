"""Volume analytics on Spark DataFrames."""
