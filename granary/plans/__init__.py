"""Composite jobs: offer metrics, data quality, forecast, prediction, radar, score, gates, weekly."""
