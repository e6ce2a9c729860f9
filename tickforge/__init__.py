"""Candle analytics over Spark DataFrames and streams."""
