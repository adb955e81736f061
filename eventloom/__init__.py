"""eventloom: batch analytics for activity logs of many interacting actors, on Spark DataFrames."""

__version__ = "0.1.0"
