"""Spark jobs that turn forum text and daily returns into volatility forecasts."""
