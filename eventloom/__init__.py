"""Telemetry analytics on Spark: canonical events in, derived tables out."""
