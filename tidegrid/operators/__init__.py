"""Operators on DataFrames of soundings, pixels, tiles and routes."""
