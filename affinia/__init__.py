"""Affinity analytics and corpus preparation on Spark."""
