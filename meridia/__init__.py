"""Meridia: a PySpark-native engine for geospatial zone lookup."""
