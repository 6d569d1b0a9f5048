"""Vector-retrieval analytics on Spark DataFrames."""
