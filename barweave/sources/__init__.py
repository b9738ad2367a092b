"""Bars and klines from tables and files."""
