"""Spark-native multi-scale time-series pyramids and the data operations around them."""

__version__ = "0.1.0"
