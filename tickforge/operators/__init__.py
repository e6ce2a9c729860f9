"""Operators of the candle engine."""
