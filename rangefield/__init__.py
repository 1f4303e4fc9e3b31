"""Spark-first analytics for indoor-positioning telemetry."""
