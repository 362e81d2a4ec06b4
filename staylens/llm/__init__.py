"""Operators for training-data pipelines: shards, duplicates, contamination, scans, tokens."""
