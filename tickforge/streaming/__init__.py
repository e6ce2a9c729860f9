"""Streaming of the candle engine."""
