"""Text-driven scene retrieval and recall evaluation on Spark DataFrames."""
