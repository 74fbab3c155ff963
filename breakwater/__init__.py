"""Change analytics for labelled collections of time series, on Spark."""

__version__ = "0.1.0"
