"""Batch jobs (and a few streams) that audit medical bills with Spark DataFrames."""
