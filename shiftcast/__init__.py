"""shiftcast: Spark-native hourly demand analytics."""

__version__ = "0.1.0"
