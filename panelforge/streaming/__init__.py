"""Structured Streaming extensions of batch operators."""
