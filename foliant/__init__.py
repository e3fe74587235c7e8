"""A PySpark-native engine for unifying, deduplicating and ranking bibliographic records."""
