"""Analytics over sampled, cumulative counters, expressed as Spark DataFrames."""
