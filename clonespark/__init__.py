"""Immune-repertoire analytics on Spark."""
