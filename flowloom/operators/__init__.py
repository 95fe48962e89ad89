"""Aggregations, sketches, lookups, rankings and alerts over DataFrames."""
