"""Skein: link analysis over Spark DataFrames."""
