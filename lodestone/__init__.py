"""lodestone: a PySpark-native engine for preparing, checking and evaluating language-model data."""

__version__ = "0.1.0"
