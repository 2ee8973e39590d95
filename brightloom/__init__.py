"""A PySpark-native analytics toolkit."""
