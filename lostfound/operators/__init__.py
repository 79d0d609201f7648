"""Joins, searches, aggregations and graph operators over DataFrames."""
