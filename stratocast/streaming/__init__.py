"""Structured Streaming versions of scoring, logging and monitoring."""
