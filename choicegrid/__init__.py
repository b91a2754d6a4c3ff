"""Behavioural-choice analytics on Spark DataFrames."""
