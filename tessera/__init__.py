"""Spark-native analytics over operational telemetry, session stores and semi-structured records."""
