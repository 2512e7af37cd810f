"""A Spark-native engine for strategy simulation and risk analytics on price bars."""

__version__ = "0.1.0"
