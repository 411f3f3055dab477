"""Clickstream conversion analytics on Spark DataFrames."""
