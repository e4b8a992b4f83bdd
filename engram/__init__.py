"""A PySpark-native analytics engine for long-term memory stores."""
