"""marlstone: content analytics on Spark DataFrames."""
