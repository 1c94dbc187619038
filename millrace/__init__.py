"""A PySpark-native engine for data preparation and corpus curation."""
