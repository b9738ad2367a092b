"""Operators of the market-research engine."""
