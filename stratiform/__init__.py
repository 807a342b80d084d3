"""Spark-first analytics for hierarchical time series and text corpora."""
