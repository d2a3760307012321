"""Quire: a PySpark-native engine for batch document extraction."""
