"""Operators on captured pages, listings and rankings: DataFrame in, DataFrame out."""
