"""heaplens: garbage-collection log analytics on Spark DataFrames."""
