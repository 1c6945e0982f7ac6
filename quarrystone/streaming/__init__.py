"""Structured Streaming forms of the batch behaviours."""
