"""Repair and evaluation of scored annotation tables, on Spark DataFrames."""
