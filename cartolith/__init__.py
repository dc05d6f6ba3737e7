"""Cartolith: a PySpark-native engine for map data, bulk collections and corpus preparation."""

__version__ = "0.1.0"
