"""Radio path-loss analytics over city tiles, on Spark DataFrames."""
