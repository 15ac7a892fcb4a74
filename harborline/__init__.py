"""PySpark-native engine for querying and maintaining operational data tables."""
