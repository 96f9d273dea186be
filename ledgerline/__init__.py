"""A PySpark-native analytics engine for software-governance data."""
