"""Landmark density analytics on Spark: cells in samples, landmarks, fuzzy maps, sample-level statistics."""
