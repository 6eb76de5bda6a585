"""Telemetry anomaly analytics and data operators on PySpark."""
