"""Profile ranking and corpus preparation on Spark DataFrames."""
