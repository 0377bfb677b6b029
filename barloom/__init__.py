"""barloom: analytics over many keyed time series of price bars, on Spark DataFrames."""

__version__ = "0.1.0"
