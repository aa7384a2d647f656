"""Spark-first analytics for deciding which places to inspect, when, and at what cost."""
