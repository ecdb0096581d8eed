"""Failure-log analytics on Spark."""
