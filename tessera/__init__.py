"""A PySpark-native engine for review analytics: pure functions from DataFrames to DataFrames."""
