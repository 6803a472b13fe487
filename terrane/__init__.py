"""Terrane: a Spark-first engine for spatial network analytics."""
