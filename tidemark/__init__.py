"""Chronological analytics on Spark: point-in-time features, encoders, metrics, audits and models."""
