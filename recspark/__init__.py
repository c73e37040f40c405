"""recspark: offline recommender retrieval, ranking and evaluation on Spark DataFrames."""
