"""pursuit: sparse representations and corpus processing on Spark DataFrames."""
