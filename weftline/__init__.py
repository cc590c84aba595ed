"""Spark-first analytics for written procedures and their process graphs."""
