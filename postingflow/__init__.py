"""Spark-native engine for job-posting pipelines."""
