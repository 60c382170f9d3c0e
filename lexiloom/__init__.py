"""Text-review analytics on Spark DataFrames."""
