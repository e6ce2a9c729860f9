"""Functions of the candle engine."""
