"""Fuzzy line completion over text collections, written as Spark DataFrame jobs."""
