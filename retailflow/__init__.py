"""Retail behaviour analytics and recommendation on Spark DataFrames."""
