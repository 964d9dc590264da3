"""Temporal walks and analytics over temporal multigraphs, on Spark DataFrames."""
