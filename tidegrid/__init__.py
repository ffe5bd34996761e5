"""Analytics of repeated seabed surveys on Spark DataFrames."""
