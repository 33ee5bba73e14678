"""gridloom: sparse-matrix, graph and clustering analytics on Spark DataFrames."""
