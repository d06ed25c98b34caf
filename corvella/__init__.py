"""Corvella: scholarly-corpus analytics and corpus preparation on Spark DataFrames."""
