"""Spark-native engine for byte-addressable dataset archives."""

__version__ = "0.1.0"
