"""Spark-first analytics over road and path networks with elevation."""
