"""Time-series and market-data analytics on Spark."""
