"""Spark-first analytics for contests between two competitors."""
