"""Evaluation jobs on Spark: scores for answers, retrieval and agents over tables."""
