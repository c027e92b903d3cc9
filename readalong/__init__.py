"""A PySpark-native engine for narrated-document analytics and training data."""
