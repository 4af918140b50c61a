"""Panels of seasonal time series on Spark: trends, scenarios, models, scores."""

__version__ = "0.1.0"
