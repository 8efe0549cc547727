"""Telemetry analytics as Spark plans."""
