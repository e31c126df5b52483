"""Scriptorium: a PySpark-native engine for documentation knowledge bases."""

__version__ = "0.1.0"
