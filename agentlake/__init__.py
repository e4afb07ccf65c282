"""Context analytics for conversation memory, on Spark DataFrames."""
