"""Tessera: relational analytics and corpus preparation on Spark DataFrames."""
