"""tessella: a PySpark-native engine for preparing and evaluating persona fine-tuning data."""

__version__ = "0.1.0"
