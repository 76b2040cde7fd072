"""Spark-native analytics for labelled arrays, event signals, neighbourhood graphs and region-wise model fits."""

__version__ = "0.1.0"
