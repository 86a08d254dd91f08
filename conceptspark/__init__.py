"""conceptspark: PySpark-native analytics over block-structured sparse dictionaries."""
