"""Strandweave: DNA-storage analytics on Spark DataFrames."""
