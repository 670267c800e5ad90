"""Code-graph and repository analytics on Spark DataFrames."""
