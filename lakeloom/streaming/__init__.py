"""Streamed input: staged sessions and a Structured Streaming adapter."""
