"""Structured Streaming over event logs and changing trees."""
