"""A corpus analytics and retrieval engine on Spark DataFrames."""
