"""Analytics over listing-style market data on Spark."""
