"""DataFrame operators: joins in time, buckets, windows, indicators, merges, backtests."""
