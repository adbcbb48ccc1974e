"""Operators for preparing text corpora for training, as Spark jobs."""
