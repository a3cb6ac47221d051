"""Vitrina: text-classification analytics for marketplace listings, on Spark DataFrames."""
