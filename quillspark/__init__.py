"""Spark-first text retrieval, evaluation and corpus analytics."""
