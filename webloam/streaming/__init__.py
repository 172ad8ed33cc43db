"""Streaming jobs over newly arriving pages and logs."""
