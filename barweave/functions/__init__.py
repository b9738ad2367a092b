"""Functions of the market-research engine."""
