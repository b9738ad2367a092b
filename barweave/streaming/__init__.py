"""Streaming of the market-research engine."""
