"""A PySpark-native analytics engine for data files of many kinds."""
