"""A PySpark-native engine for trip and road-traffic analytics."""
