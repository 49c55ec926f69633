"""Analytics over live-stream delivery measurements, on Spark DataFrames."""
