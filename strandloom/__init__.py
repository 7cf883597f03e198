"""Spark-first analytics for grouping sequence fragments into genomes."""

__version__ = "0.1.0"
