"""A PySpark-native engine for the structure of source code, and for training data."""
