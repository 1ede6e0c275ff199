"""Temporal path analytics on Spark."""
