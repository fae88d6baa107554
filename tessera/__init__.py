"""A PySpark-native analytics engine for postings, feeds and their texts."""
