"""DataFrame operators. Each takes and returns Spark DataFrames."""
