"""Diagnostics of machine-learning training histories on Spark."""
