"""Table-analysis operators on Spark DataFrames."""
