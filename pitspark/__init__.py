"""PitSpark: a PySpark-native engine for point-in-time financial data."""

__version__ = "0.1.0"
