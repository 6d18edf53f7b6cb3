"""Hourly electricity-load analytics as DataFrame functions on Spark."""
