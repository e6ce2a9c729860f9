"""Sources of the candle engine."""
