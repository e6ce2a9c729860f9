"""Plans of the candle engine."""
