"""Tensor analytics and training-corpus operators on Spark."""
