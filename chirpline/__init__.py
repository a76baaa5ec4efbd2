"""Soundscape analytics and data preparation as Spark DataFrames."""
