"""Spark-first analytics for spatial graphs, fields and curves."""
