"""Network-fact analytics and dataset building on Spark DataFrames."""
