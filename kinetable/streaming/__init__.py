"""Structured Streaming jobs over converter logs and curation detections."""
