"""Plans of the market-research engine."""
