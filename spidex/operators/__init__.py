"""Operators over DataFrames: index, segments, search, rank, frontier."""
