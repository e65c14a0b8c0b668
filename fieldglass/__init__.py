"""fieldglass: a Spark-native engine for collecting and preparing large event and text tables."""

__version__ = "0.1.0"
